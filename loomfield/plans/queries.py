"""The registered log queries, each with the SQL that DuckDB must agree with.

The SQL mostly computes its answer from the fields of `events` that the lines were rendered from, not by parsing the lines
again, so that it checks the parsers rather than repeats them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import coerce
from ..operators import monitors, neighbours, rules, triage
from ..operators.detect_format import detect_format
from ..operators.learn import fingerprints, learned_fields, mask_templates
from ..operators.normalize import json_key_patterns, normalize, with_format
from ..operators.staging import fenced
from ..operators.preparse import with_fields
from ..sources.logs import FIELDS, LINE, render_logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

EV = "ev AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in FIELDS.items()) + " FROM events)"
LINES = EV + ", lines AS (SELECT *, " + LINE.replace("bsd,", "strftime(ts, '%b %d %H:%M:%S'),").replace("iso,", "strftime(ts, '%Y-%m-%dT%H:%M:%S'),").replace("clf,", "strftime(ts, '%d/%b/%Y:%H:%M:%S'),") + " AS raw_log FROM ev)"
KIND = "CASE event_id % 5 WHEN 0 THEN 'syslog_bsd' WHEN 1 THEN 'cef' WHEN 2 THEN 'json' WHEN 3 THEN 'kv' ELSE 'clf' END"
CLASS = "CASE event_id % 5 WHEN 0 THEN 3002 WHEN 1 THEN 4001 WHEN 2 THEN CASE WHEN operation = 'ConsoleLogin' THEN 3002 ELSE 6003 END WHEN 3 THEN 3002 ELSE 4002 END"
SEVERITY = "CASE WHEN event_id % 5 = 0 AND NOT ok THEN 3 ELSE 1 END"


def query(name: str, sql: str):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        ORACLE_SQL[name] = sql
        return f

    return keep


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_format(render_logs(spark, sf_dir))


def parsed(spark: SparkSession, sf_dir: str, fmt: str) -> DataFrame:
    return with_fields(detected(spark, sf_dir).where(F.col("log_format") == fmt), [fmt])


def normalized(spark: SparkSession, sf_dir: str, *formats: str) -> DataFrame:
    return normalize(render_logs(spark, sf_dir), formats=formats or None)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumns({k: F.expr(v) for k, v in FIELDS.items()})


def field(name: str, kind: str = "string"):
    return F.element_at("fields", name).cast(kind)


def value(path: str):
    return F.element_at("event", path)


def N():
    return F.count(F.lit(1)).alias("n")


@query("auth_security_by_source", f"WITH {EV} SELECT src_ip, user_name, count(*) AS n_events, sum(CASE WHEN ok THEN 0 ELSE 1 END)::BIGINT AS n_failed FROM ev WHERE event_id % 5 = 0 GROUP BY ALL")
def auth_security_by_source(spark, sf_dir):
    scored = rules.relevance(normalized(spark, sf_dir, "syslog_bsd").where("pattern in ('sshd_accepted', 'sshd_failed')"))
    own = scored.where(rules.tier(F.col("score"), F.col("class_uid")) == "security")
    return own.groupBy(value("src_endpoint.ip").alias("src_ip"), value("user").alias("user_name")).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("status_id") == 2).alias("n_failed"))


@query("format_detect_dist", f"SELECT {KIND} AS log_format, count(*) AS n FROM events GROUP BY ALL")
def format_detect_dist(spark, sf_dir):
    return detected(spark, sf_dir).groupBy("log_format").agg(N())


_S = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query("format_detect_docs", f"""WITH d AS (SELECT doc_id, text, {_S} AS s FROM documents) SELECT doc_id, CASE WHEN text IS NULL OR length(text) < 5 OR length(s) < 1 THEN 'custom'
 WHEN s[1] = '{{' THEN 'json' WHEN s[1:2] = '[{{' THEN 'json' WHEN s[1:5] = '<?xml' OR s[1:6] = '<Event' THEN 'xml' WHEN regexp_matches(s, '^<\\d{{1,3}}>') THEN 'syslog_rfc3164' WHEN s[1] = '<' THEN 'xml'
 WHEN regexp_matches(s[1:100], 'CEF:\\d\\|') THEN 'cef' WHEN contains(s[1:200], chr(9)) AND length(s[1:500]) - length(replace(s[1:500], chr(9), '')) >= 5 THEN 'tsv'
 WHEN regexp_matches(s[1:300], '(?:^|\\s)\\w+=\\S+(?:\\s\\w+=\\S+){{2,}}') THEN 'kv' WHEN length(s[1:500]) - length(replace(s[1:500], ',', '')) >= 3 THEN 'csv' ELSE 'custom' END AS log_format FROM d""")
def format_detect_docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", detect_format(F.col("text")).alias("log_format"))


@query("preparse_syslog", f"WITH {EV} SELECT event_id AS log_id, strftime(ts, '%b %d %H:%M:%S') AS logged_at, host AS hostname, 'sshd' AS app, pid::VARCHAR AS pid FROM ev WHERE event_id % 5 = 0")
def preparse_syslog(spark, sf_dir):
    return parsed(spark, sf_dir, "syslog_bsd").select("log_id", field("timestamp").alias("logged_at"), field("hostname").alias("hostname"), field("_app").alias("app"), field("_pid").alias("pid"))


@query("preparse_cef", f"WITH {EV} SELECT event_id AS log_id, event_type AS name, event_id % 11 AS severity, src_ip, dst_ip, src_port::BIGINT AS src_port, dst_port::BIGINT AS dst_port, event_type AS act FROM ev WHERE event_id % 5 = 1")
def preparse_cef(spark, sf_dir):
    return parsed(spark, sf_dir, "cef").select("log_id", field("_name").alias("name"), field("_severity", "long").alias("severity"), field("src").alias("src_ip"), field("dst").alias("dst_ip"), field("spt", "long").alias("src_port"), field("dpt", "long").alias("dst_port"), field("act").alias("act"))


@query("preparse_json", f"WITH {EV} SELECT operation, user_name, count(*) AS n, sum(bytes)::BIGINT AS total FROM ev WHERE event_id % 5 = 2 GROUP BY ALL")
def preparse_json(spark, sf_dir):
    return parsed(spark, sf_dir, "json").groupBy(field("eventName").alias("operation"), field("userName").alias("user_name")).agg(N(), F.sum(field("bytes", "long")).alias("total"))


@query("preparse_kv", f"WITH {EV} SELECT event_type AS action, CASE WHEN ok THEN 'success' ELSE 'failure' END AS status, dst_port::BIGINT AS dst_port, count(*) AS n FROM ev WHERE event_id % 5 = 3 GROUP BY ALL")
def preparse_kv(spark, sf_dir):
    return parsed(spark, sf_dir, "kv").groupBy(field("action").alias("action"), field("status").alias("status"), field("dst_port", "long").alias("dst_port")).agg(N())


@query("preparse_clf", f"WITH {EV} SELECT concat('/item/', event_id % 97) AS url, CASE WHEN ok THEN 200 ELSE 403 END::BIGINT AS status, count(*) AS n, sum(bytes)::BIGINT AS total FROM ev WHERE event_id % 5 = 4 GROUP BY ALL")
def preparse_clf(spark, sf_dir):
    return parsed(spark, sf_dir, "clf").groupBy(field("url").alias("url"), field("status", "long").alias("status")).agg(N(), F.sum(field("size", "long")).alias("total"))


@query("pattern_specificity_pick", f"WITH {EV} SELECT CASE event_id % 5 WHEN 0 THEN CASE WHEN ok THEN 'sshd_accepted' ELSE 'sshd_failed' END WHEN 1 THEN 'firewall_traffic' WHEN 2 THEN CASE WHEN operation = 'ConsoleLogin' THEN 'console_login' ELSE 'api_call' END WHEN 3 THEN 'kv_action' ELSE 'web_access' END AS pattern, {CLASS}::INT AS class_uid, count(*) AS n FROM ev GROUP BY ALL")
def pattern_specificity_pick(spark, sf_dir):
    return normalized(spark, sf_dir).groupBy("pattern", "class_uid").agg(N())


@query("pattern_json_division", f"WITH {EV} SELECT 'login' AS pattern, count(*) AS n FROM ev WHERE event_id % 5 = 2 UNION ALL SELECT 'traffic', count(*) FROM ev WHERE event_id % 5 = 2")
def pattern_json_division(spark, sf_dir):
    keys = [("login", "eventName"), ("login", "userName"), ("traffic", "bytes"), ("traffic", "sourceIPAddress"), ("none", "bytes"), ("none", "absent")]
    return json_key_patterns(parsed(spark, sf_dir, "json"), spark.createDataFrame(keys, "pattern string, key string")).groupBy("pattern").agg(N())


@query("normalize_auth", f"WITH {EV} SELECT event_id AS log_id, user_name, src_ip, CASE WHEN ok THEN 'Success' ELSE 'Failure' END AS status, {SEVERITY}::INT AS severity_id FROM ev WHERE event_id % 5 = 0")
def normalize_auth(spark, sf_dir):
    return normalized(spark, sf_dir, "syslog_bsd").select("log_id", value("user").alias("user_name"), value("src_endpoint.ip").alias("src_ip"), value("status").alias("status"), "severity_id")


@query("normalize_json_alias", f"WITH {EV} SELECT event_id AS log_id, src_ip, user_name, operation, severity_name AS severity FROM ev WHERE event_id % 5 = 2")
def normalize_json_alias(spark, sf_dir):
    return normalized(spark, sf_dir, "json").select("log_id", value("src_endpoint.ip").alias("src_ip"), value("actor.user.name").alias("user_name"), value("api.operation").alias("operation"), value("severity").alias("severity"))


@query("coerce_ip_port", f"WITH {EV} SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE src_ip END AS ip, CASE WHEN event_id % 7 = 0 THEN NULL ELSE src_port::INT END AS port FROM ev")
def coerce_ip_port(spark, sf_dir):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat("src_ip", F.lit(".9"))).when(F.col("event_id") % 3 == 1, F.concat("src_ip", F.lit(":"), "src_port")).otherwise(F.concat(F.lit('"['), "src_ip", F.lit(']"')))
    port = F.when(F.col("event_id") % 7 == 0, F.lit("99999")).otherwise(F.concat(F.col("src_port").cast("string"), F.lit("/tcp")))
    return events(spark, sf_dir).select("event_id", coerce.ip(raw).alias("ip"), coerce.port(port).alias("port"))


@query("coerce_severity", f"WITH {EV} SELECT severity_name, CASE severity_name WHEN 'low' THEN 2 WHEN 'medium' THEN 3 WHEN 'high' THEN 4 ELSE 5 END::INT AS severity_id, count(*) AS n FROM ev GROUP BY ALL")
def coerce_severity(spark, sf_dir):
    return events(spark, sf_dir).groupBy("severity_name", coerce.severity(F.upper("severity_name")).alias("severity_id")).agg(N())


@query("coerce_timestamp", "SELECT event_id, floor(epoch(ts))::BIGINT AS seconds FROM events")
def coerce_timestamp(spark, sf_dir):
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    millis = (F.unix_timestamp("ts") * 1000).cast("string")
    return events(spark, sf_dir).select("event_id", coerce.epoch_seconds(F.when(F.col("event_id") % 2 == 0, iso).otherwise(millis)).cast("long").alias("seconds"))


@query("coerce_boolean_mac", "SELECT event_id, event_type NOT IN ('error', 'view') AS flag, concat('aa:bb:0c:', lpad((user_id % 100)::VARCHAR, 2, '0'), ':', lpad((event_id % 100)::VARCHAR, 2, '0'), ':ff') AS mac FROM events")
def coerce_boolean_mac(spark, sf_dir):
    mac = F.concat(F.lit("AA-BB-0C-"), F.lpad((F.col("user_id") % 100).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("event_id") % 100).cast("string"), 2, "0"), F.lit("-FF"))
    return events(spark, sf_dir).select("event_id", coerce.boolean(F.when(F.col("ok"), "Accept").otherwise("DENY")).alias("flag"), coerce.mac(mac).alias("mac"))


_ENTITY = """CASE WHEN regexp_full_match(token, '\\w+="?[^"]*"?') THEN 'kv_token' WHEN regexp_full_match(token, '(\\d{1,3}\\.){3}\\d{1,3}') THEN 'ip' WHEN regexp_full_match(token, '(\\d{1,3}\\.){3}\\d{1,3}:\\d+') THEN 'ip_port'
 WHEN regexp_full_match(token, '\\d\\d:\\d\\d:\\d\\d') THEN 'timestamp' WHEN regexp_full_match(token, '\\w+\\[\\d+\\]:?') THEN 'process_ref' WHEN regexp_full_match(token, '/[\\w./-]+') THEN 'path' WHEN regexp_full_match(token, '\\d+') THEN CASE WHEN token::BIGINT BETWEEN 1024 AND 65535 THEN 'port' ELSE 'integer' END
 WHEN regexp_full_match(token, '[A-Za-z_][\\w-]*\\.[\\w.-]*') AND length(token) <= 32 THEN 'hostname' WHEN regexp_full_match(token, '[A-Za-z]{3,32}') THEN 'user' ELSE 'string' END""".replace("\\\\", "\\")


@query("entity_classify", f"WITH {LINES}, tokens AS (SELECT {KIND} AS log_format, unnest(string_split(raw_log, ' ')) AS token FROM lines) SELECT log_format, {_ENTITY} AS entity, count(*) AS n FROM tokens GROUP BY ALL")
def entity_classify(spark, sf_dir):
    tokens = detected(spark, sf_dir).select("log_format", F.explode(F.split("raw_log", " ")).alias("token"))
    return tokens.groupBy("log_format", coerce.entity(F.col("token")).alias("entity")).agg(N())


def _filtered(pack: str) -> Query:
    def run(spark, sf_dir):
        action, index = rules.evaluate_pack(rules.PACKS[pack], F.col("class_uid"), F.col("severity_id"), F.lit(1.0))
        return normalized(spark, sf_dir).groupBy(action.alias("action"), index.alias("rule")).agg(N())

    return run


def _pack_sql(cases: str) -> str:
    return f"WITH {EV}, e AS (SELECT {CLASS} AS c, {SEVERITY} AS s FROM ev), r AS (SELECT {cases} AS k FROM e) SELECT k[1:4] AS action, k[5:]::INT AS rule, count(*) AS n FROM r GROUP BY ALL"


query("filter_noise", _pack_sql("CASE WHEN c = 0 THEN 'drop0' WHEN s <= 0 THEN 'drop1' ELSE 'keep3' END"))(_filtered("noise-reduction"))
query("filter_pci", _pack_sql("CASE WHEN c = 3002 THEN 'keep0' WHEN c = 4001 THEN 'keep1' WHEN s >= 3 THEN 'keep4' ELSE 'keep6' END"))(_filtered("pci-dss"))
query("filter_security", _pack_sql("CASE WHEN c // 1000 = 2 THEN 'keep0' WHEN c // 1000 = 3 THEN 'keep1' WHEN c IN (4001, 4002) THEN 'keep2' WHEN s >= 4 THEN 'keep4' ELSE 'drop5' END"))(_filtered("security-focused"))


@query("filter_two_pass", f"WITH {EV} SELECT event_type, CASE WHEN event_id % 5 = 0 AND NOT ok THEN 'keep' ELSE 'drop' END AS action, count(*) AS n FROM ev GROUP BY ALL")
def filter_two_pass(spark, sf_dir):
    pack = [("keep", {"severity_id": {"gte": 3}}), ("drop", "all")]
    own = normalized(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("log_id"), "event_type"), "log_id")
    return own.groupBy("event_type", rules.two_pass(pack, F.col("class_uid"), F.col("severity_id"), F.lit(1.0)).alias("action")).agg(N())


@query("validate_required", f"WITH {EV}, e AS (SELECT {CLASS}::INT AS class_uid FROM ev) SELECT class_uid, count(*) AS n, count(*) AS n_valid FROM e GROUP BY ALL")
def validate_required(spark, sf_dir):
    return rules.validate(normalized(spark, sf_dir)).groupBy("class_uid").agg(N(), F.count_if("valid").alias("n_valid"))


@query("validate_coverage", f"WITH {EV} SELECT {KIND} AS log_format, {CLASS}::INT AS class_uid, round(max(CASE event_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN CASE WHEN operation = 'ConsoleLogin' THEN 0.875 ELSE 1.0 END WHEN 3 THEN 0.75 ELSE 1.0 END), 6)::DOUBLE AS coverage FROM ev GROUP BY ALL")
def validate_coverage(spark, sf_dir):
    return rules.validate(normalized(spark, sf_dir)).groupBy("log_format", "class_uid").agg(F.round(F.max("coverage"), 6).alias("coverage"))


@query("observables_by_type", f"""WITH {EV}, o AS (SELECT 'User Name' AS type, 4 AS type_id FROM ev WHERE event_id % 5 <> 1 UNION ALL SELECT 'IP Address', 2 FROM ev UNION ALL SELECT 'IP Address', 2 FROM ev WHERE event_id % 5 = 1
 UNION ALL SELECT 'Port', 11 FROM ev WHERE event_id % 5 IN (0, 1, 3) UNION ALL SELECT 'Port', 11 FROM ev WHERE event_id % 5 = 1 AND src_port <> dst_port UNION ALL SELECT 'Hostname', 1 FROM ev WHERE event_id % 5 = 0
 UNION ALL SELECT 'Process Name', 9 FROM ev WHERE event_id % 5 = 0 UNION ALL SELECT 'Process ID', 15 FROM ev WHERE event_id % 5 = 0 UNION ALL SELECT 'URL String', 6 FROM ev WHERE event_id % 5 = 4) SELECT type, type_id, count(*) AS n FROM o GROUP BY ALL""")
def observables_by_type(spark, sf_dir):
    own = normalized(spark, sf_dir).select(F.explode(rules.observables(F.col("event"))).alias("o")).select("o.*")
    return own.groupBy("type", "type_id").agg(N())


@query("relevance_components", f"""WITH {EV} SELECT event_id AS log_id, CASE event_id % 5 WHEN 0 THEN 1.0 WHEN 3 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN CASE WHEN operation = 'ConsoleLogin' THEN 1.0 ELSE 0.8 END ELSE 0.6 END::DOUBLE AS subtype,
 CASE event_id % 5 WHEN 1 THEN 1.0 WHEN 2 THEN CASE WHEN operation = 'ConsoleLogin' THEN 1.0 ELSE 0.5 END WHEN 4 THEN 0.5 ELSE 1.0 END::DOUBLE AS attack FROM ev""")
def relevance_components(spark, sf_dir):
    return rules.relevance(normalized(spark, sf_dir)).select("log_id", "subtype", "attack")


@query("route_tiers", f"WITH {EV}, t AS (SELECT CASE WHEN event_id % 5 IN (1, 4) THEN 'operational' WHEN event_id % 5 = 2 AND operation <> 'ConsoleLogin' THEN 'operational' ELSE 'security' END AS tier FROM ev) SELECT x.tier, count(t.tier) AS n FROM (VALUES ('security'), ('operational'), ('compliance'), ('noise')) x(tier) LEFT JOIN t ON t.tier = x.tier GROUP BY ALL")
def route_tiers(spark, sf_dir):
    routed = rules.relevance(normalized(spark, sf_dir)).select(rules.tier(F.col("score"), F.col("class_uid")).alias("tier"))
    all_tiers = spark.createDataFrame([(t, 0) for t in ("security", "operational", "compliance", "noise")], "tier string, n long")
    return routed.groupBy("tier").agg(N()).unionByName(all_tiers).groupBy("tier").agg(F.sum("n").alias("n"))


@query("source_reputation", f"SELECT {KIND} AS log_format, CASE event_id % 5 WHEN 0 THEN 0.75 WHEN 1 THEN 0.8 WHEN 4 THEN 0.5 ELSE 0.4 END::DOUBLE AS reputation, count(*) AS n FROM events GROUP BY ALL")
def source_reputation(spark, sf_dir):
    source = F.when(F.col("log_format") == "syslog_bsd", "sshd").when(F.col("log_format") == "cef", "Firewall").when(F.col("log_format") == "clf", "web server").otherwise("application")
    return rules.relevance(normalized(spark, sf_dir), source).groupBy("log_format", "reputation").agg(N())


@query("sigma_wildcard", f"WITH {EV} SELECT user_name, count(*) AS n FROM ev WHERE user_name LIKE 'user1%' AND src_ip LIKE '10.%.1' GROUP BY ALL")
def sigma_wildcard(spark, sf_dir):
    rule = {"selection": {"User": "USER1*", "SourceIp|endswith": ".1"}, "condition": "selection"}
    own = events(spark, sf_dir)
    return own.where(rules.sigma_rule(rule, {"User": F.col("user_name"), "SourceIp": F.col("src_ip")})).groupBy("user_name").agg(N())


@query("sigma_selection_in", f"WITH {EV} SELECT event_type, severity_name, count(*) AS n FROM ev WHERE (event_type IN ('error', 'view') OR dst_port = 22) AND NOT severity_name = 'low' GROUP BY ALL")
def sigma_selection_in(spark, sf_dir):
    rule = {"sel_type": {"Type": ["error", "view"]}, "sel_port": {"Port": 22}, "quiet": {"Level": "low"}, "condition": "1 of sel_* and not quiet"}
    fields = {"Type": F.col("event_type"), "Port": F.col("dst_port").cast("string"), "Level": F.col("severity_name")}
    return events(spark, sf_dir).where(rules.sigma_rule(rule, fields)).groupBy("event_type", "severity_name").agg(N())


def _sequence_sql(window: int) -> str:
    return f"""WITH RECURSIVE own AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, epoch(ts)::DOUBLE AS t, CASE WHEN event_type = 'error' THEN 7 ELSE 8 END AS m FROM events WHERE event_type IN ('error', 'purchase')),
 st AS (SELECT DISTINCT user_id, 0::BIGINT AS rn, FALSE AS opened, 0 AS step, 0.0::DOUBLE AS first, 0::BIGINT AS alerts FROM own UNION ALL
 SELECT z.user_id, z.rn, z.opened OR z.fits, CASE WHEN z.fits AND z.step = 3 THEN 0 WHEN z.fits THEN z.step + 1 ELSE z.step END, CASE WHEN z.fits AND z.step = 3 THEN z.t ELSE z.first END, z.alerts + CASE WHEN z.fits AND z.step = 3 THEN 1 ELSE 0 END
 FROM (SELECT y.*, (y.m >> y.step) & 1 = 1 AS fits FROM (SELECT o.user_id, o.rn, o.t, o.m, s.opened, s.alerts, CASE WHEN s.opened AND o.t - s.first > {window} THEN 0 ELSE s.step END AS step, CASE WHEN NOT s.opened OR o.t - s.first > {window} THEN o.t ELSE s.first END AS first FROM st s JOIN own o ON o.user_id = s.user_id AND o.rn = s.rn + 1) y) z)
 SELECT user_id, max(alerts) AS n_alerts FROM st GROUP BY user_id"""


def _sequence(window: int) -> Query:
    def run(spark, sf_dir):
        error, bought = F.col("event_type") == "error", F.col("event_type") == "purchase"
        return rules.sequences(events(spark, sf_dir), ["user_id"], "ts", "event_id", [error, error, error, bought], float(window))

    return run


query("sequence_brute_force", _sequence_sql(259200))(_sequence(259200))
query("sequence_window_expiry", _sequence_sql(86400))(_sequence(86400))


@query("fingerprint_templates", f"WITH {EV} SELECT 'bytes|eventName|eventTime|severity|sourceIPAddress|userName' AS fingerprint, {CLASS}::INT AS class_uid, count(*) AS hits, least(count(*) / 10.0, 1.0)::DOUBLE AS confidence, count(*) >= 8 AS promotable FROM ev WHERE event_id % 5 = 2 GROUP BY ALL")
def fingerprint_templates(spark, sf_dir):
    return fingerprints(normalized(spark, sf_dir, "json"), F.lit(True)).select("fingerprint", "class_uid", "hits", "confidence", "promotable")


@query("template_mask", f"WITH {LINES}, m AS (SELECT regexp_replace(raw_log, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS template FROM lines) SELECT template, count(*) AS cluster_size FROM m GROUP BY ALL HAVING count(*) >= 2")
def template_mask(spark, sf_dir):
    return mask_templates(render_logs(spark, sf_dir))


@query("learner_verified", f"WITH {EV} SELECT {KIND} AS log_format, CASE event_id % 5 WHEN 0 THEN 7 WHEN 1 THEN 6 WHEN 2 THEN 6 WHEN 3 THEN 5 ELSE 7 END::INT AS n_fields, count(*) AS n FROM ev GROUP BY ALL")
def learner_verified(spark, sf_dir):
    return learned_fields(normalized(spark, sf_dir)).groupBy("log_format", "n_fields").agg(N())


@query("breadth", f"SELECT CASE WHEN event_id % 5 = 9 THEN 'good' ELSE 'excellent' END AS band, count(*) AS n FROM events GROUP BY ALL")
def breadth(spark, sf_dir):
    n = F.size(F.map_filter("confidence", lambda k, v: v.isin("pattern", "alias", "ner")))
    return normalized(spark, sf_dir).groupBy(F.when(n >= 5, "excellent").when(n >= 3, "good").when(n >= 1, "partial").otherwise("empty").alias("band")).agg(N())


@query("accuracy_match", f"WITH {EV} SELECT {KIND} AS log_format, 'user' AS path, count(*) AS n, count(*) AS n_match FROM ev WHERE event_id % 5 <> 1 GROUP BY ALL UNION ALL SELECT {KIND}, 'src_endpoint.ip', count(*), count(*) FROM ev WHERE event_id % 5 <> 1 GROUP BY ALL")
def accuracy_match(spark, sf_dir):
    truth = events(spark, sf_dir).select(F.col("event_id").alias("log_id"), F.explode(F.create_map(F.lit("user"), F.col("user_name"), F.lit("src_endpoint.ip"), F.col("src_ip"))).alias("path", "expected"))
    got = normalized(spark, sf_dir).where("log_format != 'cef'").join(truth, "log_id").withColumn("got", F.element_at("event", F.col("path")))
    return got.groupBy("log_format", "path").agg(N(), F.count_if(F.col("got") == F.col("expected")).alias("n_match"))


@query("schema_compliance", "SELECT 100.0::DOUBLE AS score, count(*) AS n FROM events")
def schema_compliance(spark, sf_dir):
    return rules.validate(normalized(spark, sf_dir)).agg(F.round(F.avg(F.col("valid").cast("int")) * 100, 6).alias("score"), N())


@query("type_fidelity", f"WITH {EV} SELECT 'dst_endpoint.port' AS path, count(*) AS checked, count(*) AS good FROM ev WHERE event_id % 5 IN (1, 3) UNION ALL SELECT 'src_endpoint.port', count(*), count(*) FROM ev WHERE event_id % 5 IN (0, 1) UNION ALL SELECT 'src_endpoint.ip', count(*), count(*) FROM ev UNION ALL SELECT 'dst_endpoint.ip', count(*), count(*) FROM ev WHERE event_id % 5 = 1")
def type_fidelity(spark, sf_dir):
    leaves = normalized(spark, sf_dir).select(F.explode("event").alias("path", "v")).where("path rlike '[.](ip|port)$'")
    good = F.when(F.col("path").endswith(".ip"), coerce.ip(F.col("v")).isNotNull()).otherwise(coerce.port(F.col("v")).isNotNull())
    return leaves.groupBy("path").agg(F.count(F.lit(1)).alias("checked"), F.count_if(good).alias("good"))


@query("hallucination_substring", f"WITH {EV} SELECT {KIND} AS log_format, 0::BIGINT AS n_invented FROM ev GROUP BY ALL")
def hallucination_substring(spark, sf_dir):
    own = normalized(spark, sf_dir).select("log_format", "raw_log", "confidence", F.explode("event").alias("path", "v"))
    own = own.where(~F.col("path").isin("activity_id", "status", "status_id", "severity_id", "auth_protocol") & (F.length("v") > 1))
    return own.groupBy("log_format").agg(F.count_if(~F.contains(F.lower("raw_log"), F.lower("v"))).alias("n_invented"))


@query("relationship_integrity", f"WITH {EV} SELECT 'src' AS pair, count(*) FILTER (event_id % 5 IN (0, 1)) AS paired, count(*) FILTER (event_id % 5 NOT IN (0, 1)) AS sparse FROM ev UNION ALL SELECT 'dst', count(*) FILTER (event_id % 5 = 1), 0 FROM ev")
def relationship_integrity(spark, sf_dir):
    pairs = F.array(*(F.struct(F.lit(k).alias("pair"), value(f"{k}_endpoint.ip").alias("a"), value(f"{k}_endpoint.port").alias("b")) for k in ("src", "dst")))
    own = normalized(spark, sf_dir).select(F.explode(pairs).alias("p")).select("p.*").where("a is not null")
    return own.groupBy("pair").agg(F.count_if(F.col("b").isNotNull()).alias("paired"), F.count_if(F.col("b").isNull()).alias("sparse"))


@query("attack_grouping_sets", f"WITH {EV}, e AS (SELECT {CLASS}::INT AS class_uid, (CASE WHEN event_id % 5 = 1 THEN 6 ELSE 1 END)::INT AS activity_id, event_id % 5 <> 1 AS u FROM ev) SELECT class_uid, activity_id, count(*) AS n, round(avg(u::INT), 6)::DOUBLE AS user_rate, 1.0::DOUBLE AS src_rate FROM e GROUP BY GROUPING SETS ((class_uid), (class_uid, activity_id))")
def attack_grouping_sets(spark, sf_dir):
    own = normalized(spark, sf_dir).select("class_uid", "activity_id", rules.present(F.col("event"), "user").cast("int").alias("u"), rules.present(F.col("event"), "src_endpoint.ip").cast("int").alias("s"))
    return own.groupingSets([["class_uid"], ["class_uid", "activity_id"]], "class_uid", "activity_id").agg(N(), F.round(F.avg("u"), 6).alias("user_rate"), F.round(F.avg("s"), 6).alias("src_rate"))


@query("composite_score", f"WITH {EV}, d AS (SELECT 'breadth' AS dim, 100.0 AS score, 0.3 AS w UNION ALL SELECT 'users', 100.0 * count(*) FILTER (event_id % 5 <> 1) / count(*), 0.7 FROM ev) SELECT round(sum(score * w) / sum(w), 6)::DOUBLE AS composite FROM d")
def composite_score(spark, sf_dir):
    one = normalized(spark, sf_dir).agg(F.avg((F.size("event") >= 5).cast("int")).alias("breadth"), F.avg(rules.present(F.col("event"), "user").cast("int")).alias("users"))
    return one.select(F.round(100 * (0.3 * F.col("breadth") + 0.7 * F.col("users")), 6).alias("composite"))


@query("regression_gate", "WITH h AS (SELECT event_id % 2 AS half, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) * 100 AS rate FROM events GROUP BY ALL) SELECT round(b.rate - a.rate, 6)::DOUBLE AS change, b.rate - a.rate < -2.0 AS regressed FROM h a, h b WHERE a.half = 0 AND b.half = 1")
def regression_gate(spark, sf_dir):
    rate = lambda half: F.avg(F.when(F.col("event_id") % 2 == half, (F.col("event_type") == "error").cast("int"))) * 100
    both = spark.read.parquet(f"{sf_dir}/events.parquet").agg((rate(1) - rate(0)).alias("d"))
    return both.select(F.round("d", 6).alias("change"), (F.col("d") < -2.0).alias("regressed"))


_KNN = "WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT q.vec_id, x.label, x.vec_id AS other, list_cosine_similarity(q.e, x.embedding::DOUBLE[]) AS sim FROM q, embeddings x WHERE x.vec_id <> q.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(sim, 9) DESC, other) AS rank FROM d QUALIFY rank <= 5)"


def knn(spark, sf_dir):
    """The five nearest vectors, by cosine, of a stated query set: every vector whose id is a multiple of 100."""
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0, 5)


@query("knn_topk", _KNN + " SELECT vec_id AS query, other AS vec_id, rank FROM k")
def knn_topk(spark, sf_dir):
    return knn(spark, sf_dir).select("query", "vec_id", F.col("rank").cast("long").alias("rank"))


@query("knn_classify", _KNN + ", v AS (SELECT vec_id, label, sum(sim) AS s FROM k GROUP BY ALL) SELECT vec_id AS query, label, round(s / sum(s) OVER (PARTITION BY vec_id), 6) AS confidence FROM v QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, label) = 1")
def knn_classify(spark, sf_dir):
    votes = knn(spark, sf_dir).groupBy("query", "label").agg(F.sum("sim").alias("s"))
    votes = votes.withColumn("all", F.sum("s").over(Window.partitionBy("query")))
    return rules.best_rows(votes, ["query"], [F.desc(F.round("s", 9)), F.asc("label")]).select("query", "label", F.round(F.col("s") / F.col("all"), 6).alias("confidence"))


@query("category_dir_route", f"WITH {EV} SELECT CASE {CLASS} // 1000 WHEN 3 THEN 'iam' WHEN 4 THEN 'network' ELSE 'application' END AS folder, count(*) AS n FROM ev GROUP BY ALL")
def category_dir_route(spark, sf_dir):
    folders = F.create_map(*(F.lit(x) for pair in {1: "system", 2: "findings", 3: "iam", 4: "network", 5: "discovery", 6: "application"}.items() for x in pair))
    return normalized(spark, sf_dir).groupBy(F.coalesce(F.element_at(folders, F.col("category_uid")), F.lit("raw")).alias("folder")).agg(N())


@query("log_error_window", "SELECT epoch(time_bucket(INTERVAL '5 minutes', ts))::BIGINT AS start, event_type, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) > 3")
def log_error_window(spark, sf_dir):
    own = events(spark, sf_dir).where("event_type = 'error'").groupBy(F.window("ts", "5 minutes"), "event_type").agg(N())
    return own.where("n > 3").select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")


@query("error_rate_threshold", "SELECT user_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rate FROM events GROUP BY ALL HAVING avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) > 0.05")
def error_rate_threshold(spark, sf_dir):
    rate = F.avg((F.col("event_type") == "error").cast("double"))
    return events(spark, sf_dir).groupBy("user_id").agg(rate.alias("r")).where("r > 0.05").select("user_id", F.round("r", 6).alias("rate"))


@query("issue_dedup", """WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events),
 st AS (SELECT user_id, event_type, rn, event_id, ts AS last, TRUE AS raised FROM o WHERE rn = 1 UNION ALL SELECT o.user_id, o.event_type, o.rn, o.event_id, CASE WHEN o.ts - s.last > INTERVAL 24 HOURS THEN o.ts ELSE s.last END, o.ts - s.last > INTERVAL 24 HOURS
 FROM st s JOIN o ON o.user_id = s.user_id AND o.event_type = s.event_type AND o.rn = s.rn + 1) SELECT event_id, user_id, event_type FROM st WHERE raised""")
def issue_dedup(spark, sf_dir):
    return monitors.raised(events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id", 86_400).select("event_id", "user_id", "event_type")


@query("stratified_caps", f"WITH {EV}, e AS (SELECT event_id, {CLASS} AS c, {KIND} AS f FROM ev), a AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY md5(event_id::VARCHAR)) AS r FROM e QUALIFY r <= 10) SELECT event_id AS log_id FROM a QUALIFY row_number() OVER (PARTITION BY f ORDER BY md5(event_id::VARCHAR)) <= 5")
def stratified_caps(spark, sf_dir):
    key = F.md5(F.col("log_id").cast("string").cast("binary"))
    a = rules.best_rows(normalized(spark, sf_dir).select("log_id", "class_uid", "log_format"), ["class_uid"], [key], 10)
    return rules.best_rows(a, ["log_format"], [key], 5).select("log_id")


@query("train_test_split", "SELECT event_id, ('0x' || md5(event_id::VARCHAR)[1:7])::BIGINT % 10 < 7 AS train FROM events")
def train_test_split(spark, sf_dir):
    bucket = F.conv(F.substring(F.md5(F.col("event_id").cast("string").cast("binary")), 1, 7), 16, 10).cast("long") % 10
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (bucket < 7).alias("train"))


@query("class_summary", f"WITH {EV} SELECT {CLASS}::INT AS class_uid, CASE {CLASS} WHEN 3002 THEN 'Authentication' WHEN 4001 THEN 'Network Activity' WHEN 4002 THEN 'HTTP Activity' ELSE 'API Activity' END AS class_name, count(*) AS n FROM ev GROUP BY ALL ORDER BY n DESC, class_uid LIMIT 15")
def class_summary(spark, sf_dir):
    return normalized(spark, sf_dir).groupBy("class_uid", "class_name").agg(N()).orderBy(F.desc("n"), "class_uid").limit(15)


@query("field_fuzzy_map", """WITH f AS (SELECT event_id, unnest([{'name': 'ClientAddr', 'value': concat('10.0.0.', event_id % 250)}, {'name': 'target_host_ip', 'value': CASE WHEN event_id % 3 = 0 THEN 'web' ELSE concat('10.1.0.', event_id % 250) END},
 {'name': 'http_method', 'value': CASE WHEN event_id % 4 = 0 THEN 'get' ELSE 'fetch' END}, {'name': 'Operation', 'value': event_type}, {'name': 'contact_email', 'value': CASE WHEN event_id % 2 = 0 THEN 'a@b.c' ELSE 'none' END}, {'name': 'colour', 'value': 'red'}]) AS x FROM events)
 SELECT x.name AS name, CASE x.name WHEN 'ClientAddr' THEN 'src_endpoint.ip' WHEN 'target_host_ip' THEN CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'dst_endpoint.ip' END WHEN 'http_method' THEN CASE WHEN event_id % 4 = 0 THEN 'http_request.http_method' END
 WHEN 'Operation' THEN 'activity_name' WHEN 'contact_email' THEN CASE WHEN event_id % 2 = 0 THEN 'user' END END AS path, count(*) AS n FROM f GROUP BY ALL""")
def field_fuzzy_map(spark, sf_dir):
    e = F.col("event_id")
    made = [
        ("ClientAddr", F.concat(F.lit("10.0.0."), e % 250)), ("target_host_ip", F.when(e % 3 == 0, "web").otherwise(F.concat(F.lit("10.1.0."), e % 250))), ("http_method", F.when(e % 4 == 0, "get").otherwise("fetch")),
        ("Operation", F.col("event_type")), ("contact_email", F.when(e % 2 == 0, "a@b.c").otherwise("none")), ("colour", F.lit("red")),
    ]
    rows = events(spark, sf_dir).select(F.explode(F.array(*(F.struct(F.lit(k).alias("name"), v.alias("value")) for k, v in made))).alias("x"))
    return rows.groupBy(F.col("x.name").alias("name"), triage.fuzzy_path(F.col("x.name"), F.col("x.value")).alias("path")).agg(N())


@query("reclassify_candidates", """WITH e AS (SELECT event_id, event_id % 3 AS k, (event_id % 10) / 10.0 AS score FROM events) SELECT CASE WHEN score >= 0.3 OR k = 2 THEN NULL WHEN k = 0 THEN 4001 ELSE 1007 END::INT AS new_class,
 CASE WHEN score >= 0.3 OR k = 2 THEN NULL WHEN k = 0 THEN round(5 / 7.0, 6) ELSE round(6 / 7.0, 6) END::DOUBLE AS confidence, count(*) AS n FROM e GROUP BY ALL""")
def reclassify_candidates(spark, sf_dir):
    kinds = [triage.SIGNATURES[4001][:5], triage.SIGNATURES[1007][:6], triage.SIGNATURES[4003][:4]]
    of = lambda paths: F.create_map(*(x for p in paths for x in (F.lit(p), F.concat(F.lit("v"), F.col("event_id").cast("string")))))
    k = F.col("event_id") % 3
    rows = events(spark, sf_dir).select(F.when(k == 0, of(kinds[0])).when(k == 1, of(kinds[1])).otherwise(of(kinds[2])).alias("event"), F.lit(0).alias("class_uid"), ((F.col("event_id") % 10) / 10.0).alias("score"))
    return triage.reclassify(rows).groupBy("new_class", F.round("new_confidence", 6).alias("confidence")).agg(N())


@query("route_reason", """WITH e AS (SELECT (event_id % 101) / 100.0 AS score, CASE event_id % 2 WHEN 0 THEN 3002 ELSE 4002 END AS c FROM events), t AS (SELECT score, CASE WHEN score >= 0.7 OR c = 3002 AND score >= 0.6 THEN 'security' WHEN score >= 0.3 THEN 'operational' WHEN score >= 0.1 THEN 'compliance' ELSE 'noise' END AS tier FROM e)
 SELECT tier, CASE tier WHEN 'security' THEN 'detect' WHEN 'operational' THEN 'ops' WHEN 'compliance' THEN 'archive' ELSE 'drop' END AS destination, CASE tier WHEN 'security' THEN '$$$' WHEN 'operational' THEN '$' WHEN 'compliance' THEN 'cents' ELSE 'free' END AS cost,
 printf(CASE tier WHEN 'security' THEN 'High relevance (%.2f) — security hot path' WHEN 'operational' THEN 'Moderate relevance (%.2f) — operational warm path' WHEN 'compliance' THEN 'Low relevance (%.2f) — compliance cold archive' ELSE 'Minimal relevance (%.2f) — noise, drop or sample' END, score) AS reason, count(*) AS n FROM t GROUP BY ALL""")
def route_reason(spark, sf_dir):
    score, uid = (F.col("event_id") % 101) / 100.0, F.when(F.col("event_id") % 2 == 0, 3002).otherwise(4002)
    return events(spark, sf_dir).select(triage.route(score, uid).alias("r")).groupBy("r.tier", "r.destination", "r.cost", "r.reason").agg(N())


@query("accuracy_tolerant", "SELECT event_id % 4 AS kind, count(*) AS n, count(*) FILTER (event_id % 4 IN (0, 1)) AS n_same FROM events GROUP BY ALL")
def accuracy_tolerant(spark, sf_dir):
    e = F.col("event_id")
    got = F.when(e % 4 == 0, e.cast("string")).when(e % 4 == 1, F.concat(e.cast("string"), F.lit(".0"))).when(e % 4 == 2, F.concat(F.lit("x"), e.cast("string")))
    return events(spark, sf_dir).groupBy((e % 4).alias("kind")).agg(N(), F.count_if(triage.same_value(e, got)).alias("n_same"))
