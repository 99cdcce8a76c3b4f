"""Registered queries of sequences, Sigma rules, schemas, templates, cache, cascade and nested JSON, each with its SQL."""

from __future__ import annotations


import yaml
from pyspark.sql import functions as F

from ..functions import network
from ..operators import cache as caches
from ..operators import evaluate, golden, schemas, sequences, sigma, templates
from ..operators.cascade import cascade
from ..operators.normalize import normalize
from ..sources import columns
from ..sources.logs import ODD_LINE, render_logs, render_odd
from ..sources.shared import saved, shared_dir
from ..streaming import sequences as streams
from .queries import CLASS, EV, N, events, normalized, parsed, query, value

ODD = EV + ", odd AS (SELECT *, " + ODD_LINE.replace("bsd,", "strftime(ts, '%b %d %H:%M:%S'),").replace("iso,", "strftime(ts, '%Y-%m-%dT%H:%M:%S'),").replace("AS STRING", "AS VARCHAR") + " AS raw_log FROM ev)"

ERRORS_THEN_BUYS = sequences.Sequence("Errors, then a purchase", "", 259_200, ("user_id",), ({"event_type": "error"},) * 3 + ({"event_type": "purchase"},))


def _alert_sql(window: int, evict: bool) -> str:
    """A step for each event of a user: what the state is after it, and the number of events of an alert that it completes."""
    late = f"s.opened AND o.t - s.first > {window}"
    old = "s.opened" if not evict else f"s.opened AND NOT ({late})"
    return f"""WITH RECURSIVE own AS (SELECT user_id, ts, epoch(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, CASE event_type WHEN 'error' THEN 7 WHEN 'purchase' THEN 8 ELSE 0 END AS m FROM events),
 st AS (SELECT DISTINCT user_id, NULL::TIMESTAMP AS ts, 0::BIGINT AS rn, FALSE AS opened, 0 AS step, 0.0::DOUBLE AS first, 0::BIGINT AS n, 0::BIGINT AS alert FROM own UNION ALL
 SELECT user_id, ts, rn, CASE WHEN was THEN TRUE ELSE m & 1 = 1 END, CASE WHEN NOT was THEN m & 1 WHEN fits AND step = 3 THEN 0 WHEN fits THEN step + 1 ELSE step END, CASE WHEN NOT was OR fits AND step = 3 THEN t ELSE first END,
  CASE WHEN NOT was OR fits AND step = 3 THEN 1 WHEN fits THEN n + 1 ELSE n END, CASE WHEN was AND fits AND step = 3 THEN n + 1 ELSE 0 END
 FROM (SELECT y.*, (y.m >> y.step) & 1 = 1 AS fits FROM (SELECT o.user_id, o.ts, o.rn, o.t, o.m, {old} AS was, CASE WHEN {late} THEN 0 ELSE s.step END AS step, CASE WHEN {late} THEN o.t ELSE s.first END AS first, CASE WHEN {late} THEN 1 ELSE s.n END AS n FROM st s JOIN own o ON o.user_id = s.user_id AND o.rn = s.rn + 1) y) z)
 SELECT user_id::VARCHAR AS user_id, epoch_us(ts)::BIGINT AS at_us, alert AS event_count FROM st WHERE alert > 0"""


def _alerted(found):
    return found.select(F.col("key")[0].alias("user_id"), F.unix_micros("timestamp").alias("at_us"), F.col("event_count").cast("long").alias("event_count"))


@query("sequence_alerts", _alert_sql(259_200, False))
def sequence_alerts(spark, sf_dir):
    return _alerted(sequences.alerts(events(spark, sf_dir), [ERRORS_THEN_BUYS], "ts", "event_id", F.col))


@query("sequence_alerts_stream", _alert_sql(259_200, True))
def sequence_alerts_stream(spark, sf_dir):
    """The events arrive in three files by time; a last one only moves the watermark on."""
    folder = shared_dir(spark)
    table = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.col("user_id").cast("long").alias("user_id"), "event_type")
    first, last = table.agg(F.min("ts"), F.max("ts")).first()
    if first is None:
        return _alerted(sequences.alerts(events(spark, sf_dir), [ERRORS_THEN_BUYS], "ts", "event_id", F.col, evict=True))
    cuts = [first + (last - first) * k / 3 for k in range(4)]
    for k in range(3):
        part = table.where((F.col("ts") >= F.lit(cuts[k])) & (F.col("ts") < F.lit(cuts[k + 1]) if k < 2 else F.col("ts") >= F.lit(cuts[2])))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/events")
    end = table.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select(F.lit(None).cast("long").alias("event_id"), "ts", F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"))
    end.coalesce(1).write.mode("append").parquet(f"{folder}/events")
    read = streams.rocksdb_state(spark).readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/events")
    found = streams.alert_stream(read, [ERRORS_THEN_BUYS], "ts", "event_id", F.col, "1 hour")
    job = found.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/alerts").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return _alerted(spark.read.schema(found.schema).parquet(f"{folder}/alerts"))


RULES = """
title: Failed login of a first user
id: r1
level: high
logsource: {category: authentication}
tags: [attack.t1110.001, attack.credential_access]
detection:
  selection: {User: user1*, status: Failure}
  mine: {User: user1*}
  host: {Hostname: [host1, host2]}
  condition: mine and host
---
title: Remote desktop
id: r2
level: low
logsource: {category: network_connection}
tags: [attack.lateral_movement, attack.T1021]
detection:
  ports: {DestinationPort: [3389, 22]}
  quiet: {SourceIp|startswith: '10.1'}
  condition: ports and not quiet
---
title: Any class, address ending in 7
level: odd
detection:
  tail: {src_ip|endswith: '.7'}
  condition: tail
---
title: Never
logsource: {category: dns_query}
detection:
  q: {QueryName: '*'}
  condition: q
"""


def rules_of(text: str) -> list[sigma.Rule]:
    return [r for raw in yaml.safe_load_all(text) if (r := sigma.rule_of(raw)) is not None]


@query("sigma_alerts", f"""WITH {EV}, e AS (SELECT *, {CLASS} AS c FROM ev), a AS (
 SELECT 'Failed login of a first user' AS title, 'high' AS severity, 'T1110.001' AS techniques, 'TA0006' AS tactics FROM e WHERE c = 3002 AND event_id % 5 = 0 AND user_name LIKE 'user1%' AND host IN ('host1', 'host2')
 UNION ALL SELECT 'Remote desktop', 'low', 'T1021', 'TA0008' FROM e WHERE c = 4001 AND dst_port IN (3389, 22) AND NOT src_ip LIKE '10.1%'
 UNION ALL SELECT 'Any class, address ending in 7', 'medium', '', '' FROM e WHERE src_ip LIKE '%.7') SELECT title, severity, techniques, tactics, count(*) AS n FROM a GROUP BY ALL""")
def sigma_alerts(spark, sf_dir):
    found = sigma.alerts(normalized(spark, sf_dir), rules_of(RULES), "ts", "log_id")
    return found.groupBy("title", "severity", F.array_join("techniques", ",").alias("techniques"), F.array_join("tactics", ",").alias("tactics")).agg(N())


SCHEMAS = [
    (0, "Base Event", None, None, None),
    (3002, "Authentication", "user", "string", "required"), (3002, "Authentication", "src_endpoint", "object", "required"), (3002, "Authentication", "auth_protocol", "string", "recommended"), (3002, "Authentication", "device", "object", "optional"),
    (6003, "API Activity", "api", "object", "required"), (6003, "API Activity", "src_endpoint", "object", "required"), (6003, "API Activity", "actor", "object", "required"),
]


def _odd_validated(spark, sf_dir):
    table = spark.createDataFrame(SCHEMAS, schemas.TABLE)
    return schemas.validate(normalize(render_odd(spark, sf_dir)).where("pattern IS NOT NULL"), table)


@query("schema_errors", f"""WITH {EV}, e AS (SELECT event_id % 6 AS k, CASE WHEN event_id % 6 = 3 THEN 3002 WHEN event_id % 5 = 0 THEN 6003 ELSE 3002 END AS class_uid, event_id FROM ev WHERE event_id % 6 IN (3, 4)), x AS (
 SELECT class_uid, 'src_endpoint' AS field FROM e WHERE k = 4 AND event_id % 7 = 0 OR k = 3 AND event_id % 4 = 3 AND event_id % 9 = 0 UNION ALL SELECT class_uid, 'actor' FROM e WHERE k = 4 AND event_id % 5 = 0)
 SELECT class_uid::INT AS class_uid, field, 'missing_required' AS error_type, count(*) AS n FROM x GROUP BY ALL""")
def schema_errors(spark, sf_dir):
    return _odd_validated(spark, sf_dir).select("class_uid", F.explode("errors").alias("e")).groupBy("class_uid", "e.field", "e.error_type").agg(N())


@query("schema_valid", f"""WITH {EV}, e AS (SELECT event_id % 6 AS k, CASE WHEN event_id % 6 = 3 THEN 3002 WHEN event_id % 5 = 0 THEN 6003 ELSE 3002 END AS class_uid,
 event_id % 6 = 4 AND (event_id % 7 = 0 OR event_id % 5 = 0) OR event_id % 6 = 3 AND event_id % 4 = 3 AND event_id % 9 = 0 AS bad FROM ev WHERE event_id % 6 IN (3, 4)) SELECT class_uid::INT AS class_uid, NOT bad AS valid, count(*) AS n FROM e GROUP BY ALL""")
def schema_valid(spark, sf_dir):
    return _odd_validated(spark, sf_dir).groupBy("class_uid", "valid").agg(N())


@query("json_nested_fields", f"""WITH {EV}, j AS (SELECT * FROM ev WHERE event_id % 6 = 0), f AS (SELECT 'detail.user.name' AS path, user_name AS v FROM j UNION ALL SELECT 'detail.user.role.id', (event_id % 9)::VARCHAR FROM j
 UNION ALL SELECT 'detail.net.from.client_ip', src_ip FROM j UNION ALL SELECT 'eventName', operation FROM j UNION ALL SELECT 'wide.target', dst_ip FROM j) SELECT path, count(*) AS n, count(DISTINCT v) AS n_values, min(v) AS least, max(v) AS most FROM f GROUP BY ALL""")
def json_nested_fields(spark, sf_dir):
    """Fields of nested objects at any depth; `wide` has too many keys to be opened and is reached by a dotted name."""
    from ..operators.normalize import with_format
    from ..operators.preparse import leaves, with_fields

    own = with_fields(with_format(render_odd(spark, sf_dir))).where("log_format = 'json' AND log_id % 6 = 0")
    some = F.map_filter("fields", lambda k, v: (F.contains(k, F.lit(".")) | (k == "eventName")) & ~v.startswith("{"))
    wide = F.map_filter(leaves(F.col("raw_log")), lambda k, v: k == "wide.target")
    pairs = own.select(F.explode(F.map_concat(some, wide)).alias("path", "v"))
    return pairs.groupBy("path").agg(N(), F.count_distinct("v").alias("n_values"), F.min("v").alias("least"), F.max("v").alias("most"))


@query("json_fallback_events", f"WITH {EV} SELECT event_id AS log_id, src_ip, operation, user_name FROM ev WHERE event_id % 6 = 0")
def json_fallback_events(spark, sf_dir):
    """Nested lines without a pattern, by the known last parts of their paths; the user by a dotted name."""
    from ..operators.preparse import leaves

    own = normalize(render_odd(spark, sf_dir)).where("log_format = 'json' AND pattern IS NULL")
    return own.select("log_id", value("src_endpoint.ip").alias("src_ip"), value("api.operation").alias("operation"), F.element_at(leaves(F.col("raw_log")), "detail.user.name").alias("user_name"))


@query("leef_tabs", f"WITH {EV} SELECT 'login by host=web ok' AS msg, count(*) AS n, count(DISTINCT user_name) AS n_users, 0::BIGINT AS n_invented FROM ev WHERE event_id % 6 = 2")
def leef_tabs(spark, sf_dir):
    from ..operators.normalize import with_format
    from ..operators.preparse import with_fields

    own = with_fields(with_format(render_odd(spark, sf_dir))).where("log_format = 'leef'")
    at = lambda k: F.element_at("fields", k)
    return own.groupBy(at("msg").alias("msg")).agg(N(), F.count_distinct(at("username")).alias("n_users"), F.count_if(F.map_contains_key("fields", "host")).alias("n_invented"))


@query("scrubbed_odd_values", f"WITH {EV} SELECT event_id % 4 = 3 AS bad_ip, event_id % 9 = 0 AS bad_port, count(*) AS n, count(*) FILTER (event_id % 4 <> 3) AS n_ip, count(*) FILTER (event_id % 9 <> 0) AS n_port FROM ev WHERE event_id % 6 = 3 GROUP BY ALL")
def scrubbed_odd_values(spark, sf_dir):
    own = normalize(render_odd(spark, sf_dir)).where("pattern = 'sshd_failed'")
    there = lambda path: F.count_if(value(path).isNotNull())
    return own.groupBy((F.col("log_id") % 4 == 3).alias("bad_ip"), (F.col("log_id") % 9 == 0).alias("bad_port")).agg(N(), there("src_endpoint.ip").alias("n_ip"), there("src_endpoint.port").alias("n_port"))


_TEMPLATES = """SELECT concat(strftime(ts, '%b'), ' <*> <*> <*> <*> <*> password for <*> from <*> port <*> ssh2') AS template FROM ev WHERE event_id % 5 = 0
 UNION ALL SELECT concat('<*> <*> <*> <*> act=', event_type) FROM ev WHERE event_id % 5 = 1 UNION ALL SELECT '<*>' FROM ev WHERE event_id % 5 = 2
 UNION ALL SELECT concat('<*> <*> action=', event_type, ' <*> <*> status=', CASE WHEN ok THEN 'success' ELSE 'failure' END) FROM ev WHERE event_id % 5 = 3
 UNION ALL SELECT '<*> - <*> <*> +0000] "GET <*> HTTP/1.1" <*> <*>' FROM ev WHERE event_id % 5 = 4"""


@query("template_clusters", f"WITH {EV}, t AS ({_TEMPLATES}) SELECT template, count(*) AS cluster_size FROM t GROUP BY ALL HAVING count(*) >= 2")
def template_clusters(spark, sf_dir):
    return templates.mine(render_logs(spark, sf_dir), "log_id").select("template", "cluster_size")


@query("template_slot_fields", f"WITH {EV} SELECT event_id AS log_id, src_ip, src_port::VARCHAR AS src_port FROM ev WHERE event_id % 6 = 1")
def template_slot_fields(spark, sf_dir):
    """Slots of lines of no known format: the address after `from`, the port after `port`, though the session's number may look like one."""
    logs = render_odd(spark, sf_dir)
    own = templates.extract(logs, templates.mine(logs, "log_id")).where("raw_log LIKE 'session %'")
    at = lambda k: F.element_at("template_fields", k)
    return own.select("log_id", at("src_endpoint.ip").alias("src_ip"), at("src_endpoint.port").alias("src_port"))


@query("cache_field_maps", f"""WITH {EV}, e AS (SELECT *, {CLASS}::INT AS class_uid FROM ev WHERE event_id % 5 = 2) SELECT 'bytes|eventName|eventTime|severity|sourceIPAddress|userName' AS fingerprint, class_uid,
 'bytes=traffic.bytes,eventName=api.operation,eventTime=time,severity=severity,sourceIPAddress=src_endpoint.ip,userName=user' AS field_map, count(*) AS hits, count(*) FILTER (ok) AS passes FROM e GROUP BY ALL""")
def cache_field_maps(spark, sf_dir):
    own = normalized(spark, sf_dir, "json").join(events(spark, sf_dir).select(F.col("event_id").alias("log_id"), "ok"), "log_id")
    learned = caches.learn(own, caches.empty(spark), "ts", "log_id", F.col("ok"))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("field_map")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return learned.select("fingerprint", "class_uid", pairs.alias("field_map"), "hits", "passes")


@query("cascade_tiers", f"""WITH {EV}, t AS (SELECT CASE WHEN event_id % 6 = 4 AND event_id % 5 > 0 THEN 'cache' WHEN event_id % 6 IN (0, 3, 4) THEN 'pattern' WHEN event_id % 6 = 1 THEN 'template' END AS method FROM ev) SELECT method, CASE method WHEN 'cache' THEN 0 ELSE CASE WHEN method IS NOT NULL THEN 1 END END::INT AS tier, count(*) AS n FROM t GROUP BY ALL""")
def cascade_tiers(spark, sf_dir):
    """A cache learned from the odd lines' logins; then patterns, known names, templates; what says too little is left."""
    logs = render_odd(spark, sf_dir)
    known = normalize(logs.where("raw_log LIKE '%\"userName\"%'"))
    cache = caches.learn(known, caches.empty(spark), "ts", "log_id")
    out, _ = cascade(logs, "log_id", "ts", cache, None, templates.mine(logs, "log_id"))
    return out.groupBy("method", "tier").agg(N())


@query("cached_events", f"WITH {EV} SELECT event_id AS log_id, TRUE AS cached, user_name, CASE WHEN event_id % 7 = 0 THEN NULL ELSE src_ip END AS src_ip FROM ev WHERE event_id % 6 = 4 AND event_id % 5 > 0")
def cached_events(spark, sf_dir):
    """Lines that the cache answers give what the patterns gave, without a pattern being tried; values that can't be are scrubbed later."""
    logs = render_odd(spark, sf_dir).where("raw_log LIKE '%\"userName\"%'")
    cache = caches.learn(normalize(logs), caches.empty(spark), "ts", "log_id")
    out = caches.apply(logs.withColumn("class_uid", F.lit(3002)), cache)
    at = lambda k: F.element_at("cached_event", k)
    return out.select("log_id", "cached", at("user").alias("user_name"), F.nullif(at("src_endpoint.ip"), F.lit("unknown")).alias("src_ip"))




NETWORKS = [("10.0.0.0/8", "all"), ("10.0.0.0/10", "low"), ("10.7.0.0/16", "seven"), ("10.7.128.0/17", "seven high"), ("2001:db8::/32", "documentation"), ("not a network", "none")]


@query("network_longest_prefix", f"WITH {EV}, e AS (SELECT CASE WHEN event_id % 10 = 9 THEN 'documentation' WHEN user_id % 200 = 7 AND event_id % 250 >= 128 THEN 'seven high' WHEN user_id % 200 = 7 THEN 'seven' WHEN user_id % 200 < 64 THEN 'low' ELSE 'all' END AS label FROM ev) SELECT label, count(*) AS n FROM e GROUP BY ALL")
def network_longest_prefix(spark, sf_dir):
    """A group holds four digits, so a user's number of up to 64 bits is written in four groups."""
    groups = F.concat_ws(":", *(F.lower(F.hex(F.shiftright("user_id", shift).bitwiseAND(0xFFFF))) for shift in (48, 32, 16, 0)))
    address = F.when(F.col("event_id") % 10 == 9, F.concat(F.lit("2001:db8::"), groups)).otherwise(F.col("src_ip"))
    rows = events(spark, sf_dir).select(address.alias("address"))
    return network.with_network(rows, "address", spark.createDataFrame(NETWORKS, "cidr string, label string")).groupBy("label").agg(N())


@query("ip_keys", f"WITH {EV} SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('20010db8', repeat('0', 16), lpad(printf('%x', user_id), 4, '0'), lpad(printf('%x', event_id % 65536), 4, '0')) WHEN event_id % 7 = 0 THEN NULL ELSE concat(repeat('0', 20), 'ffff', printf('%02x%02x%02x%02x', 10::BIGINT, user_id % 200, event_id % 250, 1 + user_id % 250)) END AS ip FROM ev")
def ip_keys(spark, sf_dir):
    """A user's group holds four digits at most: of a longer number the first four, as the SQL's lpad leaves them."""
    six = F.concat(F.lit("[2001:DB8::"), F.substring(F.hex("user_id"), 1, 4), F.lit(":"), F.hex(F.col("event_id") % 65536), F.lit("]"))
    address = F.when(F.col("event_id") % 2 == 0, six).when(F.col("event_id") % 7 == 0, F.concat("src_ip", F.lit(".1"))).otherwise(F.col("src_ip"))
    return events(spark, sf_dir).select("event_id", network.ip_key(address).alias("ip"))


@query("parquet_columns", f"WITH {EV} SELECT event_id % 6 AS kind, count(*) AS n, count(*) FILTER (event_id % 6 = 3 OR event_id % 6 = 4 AND event_id % 5 > 0) AS n_user, count(*) FILTER (event_id % 6 = 0 OR event_id % 6 = 3 AND event_id % 4 <> 3 OR event_id % 6 = 4 AND event_id % 7 <> 0) AS n_src_ip FROM ev GROUP BY ALL")
def parquet_columns(spark, sf_dir):
    """Two batches with different keys, appended with columns of their own and read back as one table."""
    path = shared_dir(spark)
    odd = normalize(render_odd(spark, sf_dir)).select("log_id", "event")
    for part in ("log_id % 6 < 2", "log_id % 6 >= 2"):
        columns.append_columns(saved(odd.where(part)), path)
    own = columns.read_columns(spark, path)
    return own.groupBy((F.col("log_id") % 6).alias("kind")).agg(N(), F.count("`user`").alias("n_user"), F.count("`src_endpoint.ip`").alias("n_src_ip"))


@query("golden_rejections", f"""WITH {ODD.replace("WITH ", "")}, known AS (SELECT DISTINCT raw_log FROM odd WHERE event_id % 60 IN (3, 4)), e AS (SELECT o.*, event_id % 6 AS k, o.raw_log IN (SELECT raw_log FROM known) AS old FROM odd o WHERE event_id % 6 IN (3, 4)),
 r AS (SELECT k, CASE WHEN k = 3 AND event_id % 4 = 3 AND event_id % 9 = 0 OR k = 4 AND (event_id % 7 = 0 OR event_id % 5 = 0) THEN 'schema' WHEN old THEN 'known' ELSE 'golden' END AS verdict FROM e) SELECT k AS kind, verdict, count(*) AS n FROM r GROUP BY ALL""")
def golden_rejections(spark, sf_dir):
    logs, table = render_odd(spark, sf_dir), spark.createDataFrame(SCHEMAS, schemas.TABLE)
    found = golden.candidates(normalize(logs).where("pattern IS NOT NULL"), table, logs.where("log_id % 60 IN (3, 4)"))
    return found.groupBy((F.col("log_id") % 6).alias("kind"), F.coalesce("rejected", F.lit("golden")).alias("verdict")).agg(N())


@query("invented_values", f"WITH {EV} SELECT event_id % 6 AS kind, count(*) AS n, count(*) FILTER (event_id % 6 = 3) AS n_status FROM ev WHERE event_id % 6 IN (3, 4) GROUP BY ALL")
def invented_values(spark, sf_dir):
    """`Failure` is a pattern's fixed value that its lines don't say; all other values stand in their lines."""
    own = golden.invented(normalize(render_odd(spark, sf_dir)).where("pattern IS NOT NULL"))
    return own.groupBy((F.col("log_id") % 6).alias("kind")).agg(N(), F.count_if(F.map_contains_key("invented", "status") & (F.size("invented") == 1)).alias("n_status"))


def _odd_compared(spark, sf_dir):
    """The users and addresses that the odd lines were rendered with, against what their events have."""
    logs = render_odd(spark, sf_dir)
    got = saved(normalize(logs).select("log_id", "event"))
    truth = events(spark, sf_dir).where("event_id % 6 IN (3, 4)").select(F.col("event_id").alias("log_id"), F.create_map(F.lit("user"), F.col("user_name"), F.lit("src_endpoint.ip"), F.col("src_ip")).alias("expected"))
    return evaluate.compared(got, truth, "log_id")


@query("accuracy_odd_lines", f"WITH {EV}, o AS (SELECT * FROM ev WHERE event_id % 6 IN (3, 4)) SELECT event_id % 6 AS kind, 'user' AS path, count(*) AS n, count(*) FILTER (event_id % 6 = 3 OR event_id % 5 > 0) AS n_same FROM o GROUP BY ALL UNION ALL SELECT event_id % 6, 'src_endpoint.ip', count(*), count(*) FILTER (CASE event_id % 6 WHEN 3 THEN event_id % 4 <> 3 ELSE event_id % 7 <> 0 END) FROM o GROUP BY ALL")
def accuracy_odd_lines(spark, sf_dir):
    return _odd_compared(spark, sf_dir).groupBy((F.col("log_id") % 6).alias("kind"), "path").agg(N(), F.count_if("same").alias("n_same"))


@query("accuracy_worst_paths", f"WITH {EV}, o AS (SELECT * FROM ev WHERE event_id % 6 IN (3, 4)), w AS (SELECT 'user' AS path, user_name AS v FROM o WHERE event_id % 6 = 4 AND event_id % 5 = 0 UNION ALL SELECT 'src_endpoint.ip', src_ip FROM o WHERE CASE event_id % 6 WHEN 3 THEN event_id % 4 = 3 ELSE event_id % 7 = 0 END) SELECT path, count(*) AS mismatches, min(v) AS first_example FROM w GROUP BY ALL")
def accuracy_worst_paths(spark, sf_dir):
    _, worst = evaluate.accuracy(_odd_compared(spark, sf_dir))
    return worst.select("path", F.col("mismatches").cast("long").alias("mismatches"), F.col("examples")[0]["expected"].alias("first_example"))


@query("observables_ratio", f"WITH {EV}, e AS (SELECT CASE event_id % 5 WHEN 0 THEN 7 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 4 END AS eligible, CASE event_id % 5 WHEN 0 THEN 6 WHEN 1 THEN CASE WHEN src_port = dst_port THEN 3 ELSE 4 END WHEN 2 THEN 2 ELSE 3 END AS built FROM ev) SELECT sum(eligible)::BIGINT AS eligible, sum(built)::BIGINT AS built, round(100.0 * sum(built) / sum(eligible), 6)::DOUBLE AS score FROM e")
def observables_ratio(spark, sf_dir):
    return evaluate.observables_score(normalized(spark, sf_dir)).withColumn("score", F.round("score", 6))
