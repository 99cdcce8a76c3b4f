"""From raw lines to OCSF events: patterns by specificity, aliases with provenance, required fields, scrubbing.

An event is a map of dotted path to text, with its class, activity, status and severity as numbers beside it, and
`confidence`, a map of path to the method that set it. Everything is one projection over the lines, without a shuffle; only the test of many JSON key sets (`json_key_patterns`) is a join of its own.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce
from .detect_format import bare_line, detect_format
from .library import DEFAULT, ENTRIES, Library, extracted
from .preparse import as_map, entry, with_fields
from .staging import fenced, spread, tuned

# OCSF class names.
CLASSES = {0: "Base Event", 3002: "Authentication", 4001: "Network Activity", 4002: "HTTP Activity", 6003: "API Activity", 3001: "Account Change", 2004: "Detection Finding", 1007: "Process Activity"}
# Field names and the OCSF paths that they mean.
ALIASES = {
    "src": "src_endpoint.ip", "src_ip": "src_endpoint.ip", "sourceIPAddress": "src_endpoint.ip", "client_ip": "src_endpoint.ip", "srcip": "src_endpoint.ip",
    "dst": "dst_endpoint.ip", "dst_ip": "dst_endpoint.ip", "dest_ip": "dst_endpoint.ip", "destinationIPAddress": "dst_endpoint.ip",
    "spt": "src_endpoint.port", "src_port": "src_endpoint.port", "dpt": "dst_endpoint.port", "dst_port": "dst_endpoint.port",
    "user": "user", "username": "user", "userName": "user", "suser": "user", "duser": "user", "uid": "actor.user.uid",
    "act": "activity_name", "action": "activity_name", "eventName": "api.operation", "eventSource": "api.service.name", "status": "status", "outcome": "status",
    "host": "device.hostname", "hostname": "device.hostname", "dvchost": "device.hostname", "_app": "process.name", "_pid": "process.pid",
    "time": "time", "timestamp": "time", "eventTime": "time", "rt": "time", "severity": "severity", "_severity": "severity",
    "url": "http_request.url.path", "method": "http_request.http_method", "size": "traffic.bytes_out", "bytes": "traffic.bytes", "proto": "connection_info.protocol_name",
}


def with_format(logs: DataFrame) -> DataFrame:
    """logs(…, raw_log) with log_format."""
    tuned(logs.sparkSession)
    out = fenced(spread(logs), __bare=bare_line(F.col("raw_log")))
    return fenced(out, log_format=detect_format(F.col("raw_log"), F.col("__bare"))).drop("__bare")


def aliased(fields: Column, aliases: dict[str, str] = ALIASES) -> Column:
    """(key, value) entries, by path, of the fields whose names, or else their last parts, are known; the first in order of
    field name comes last."""
    table = F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair))
    plain = F.filter(F.map_entries(fields), lambda e: ~F.coalesce(e["value"].startswith("{"), F.lit(False)))  # objects speak through their parts
    made = F.transform(F.reverse(F.array_sort(plain)), lambda e: entry(F.coalesce(F.element_at(table, e["key"]), F.element_at(table, F.substring_index(e["key"], ".", -1))), e["value"]))
    return F.filter(made, lambda e: e["key"].isNotNull())


def normalize(logs: DataFrame, library: Library | None = None, fallback: int = 3, where: Column | None = None, formats: Iterable[str] | None = None) -> DataFrame:
    """logs(…, raw_log) with log_format, fields, pattern, class_uid, class_name, event, confidence and hot columns.

    The library's best pattern decides the class. Its fields come first, then its fixed values, then fields with known names;
    a line without a pattern is taken from names alone if at least `fallback` are known.

    Filters of the result don't pass the steps below. What is known before goes in here: `where`, of columns of logs, reaches
    the scan; of `formats` alone the lines are parsed, and only their parsers and patterns are in the plan.
    """
    library = library or DEFAULT
    raw, fields, none = F.col("raw_log"), F.col("fields"), F.array().cast(ENTRIES)
    formats = None if formats is None else set(formats)
    out = with_format(logs if where is None else logs.where(where))
    out = with_fields(out if formats is None else out.where(F.col("log_format").isin(*sorted(formats))), formats)
    out = fenced(out, pattern_no=library.choose(raw, F.col("log_format"), fields, formats))
    row = F.col("__row")
    out = fenced(out, __row=library.row(F.col("pattern_no")))
    out = fenced(out, pattern=row["pattern"], by_pattern=F.coalesce(extracted(raw, fields, row), none), by_alias=F.coalesce(aliased(fields), none))
    by_alias = F.when(F.col("pattern").isNotNull() | (F.size("by_alias") >= fallback), F.col("by_alias")).otherwise(none)
    out = fenced(out, by_alias=by_alias)
    names = lambda entries, how: F.transform(entries, lambda e: entry(e["key"], F.lit(how)))
    out = fenced(out, event=as_map(F.concat("by_alias", "by_pattern")), confidence=as_map(F.concat(names(F.col("by_alias"), "alias"), names(F.col("by_pattern"), "pattern"))))
    titles = F.create_map(*(F.lit(x) for pair in CLASSES.items() for x in pair))
    out = out.withColumn("class_uid", F.coalesce(row["class_uid"], F.lit(0)))
    out = out.withColumn("class_name", F.coalesce(row["class_name"], F.element_at(titles, F.col("class_uid")), F.format_string("Unknown (%d)", "class_uid")))
    out = out.drop("by_pattern", "by_alias", "pattern_no", "__row")
    return scrub(required_fields(out))


ADDRESS = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"
NOWHERE = ["127.0.0.1", "0.0.0.0", "255.255.255.255"]
LOGINS = (3002, 3003, 3005)
FAILED, PASSED = r"(?i)fail|denied|invalid|error|reject", r"(?i)success|accept|granted|logged in|session opened|logon"


def plausible_time(v: Column) -> Column:
    """Not a placeholder nor an address; a number after 2000; text of eight characters or more."""
    number = v.try_cast("double")
    return ~F.contains(v, F.lit("@")) & ~v.rlike("^[%$<{]") & F.when(number.isNotNull(), number > 946_684_800).otherwise(F.length(v) >= 8)


def required_fields(events: DataFrame) -> DataFrame:
    """Adds what can be told from the line and its parsed fields, where the event lacks it: host, acting user, time, ports
    beside addresses, process name and number, acting user's number, status of logins, a source address."""
    at = lambda k: F.element_at("event", k)
    part = lambda k: F.element_at("fields", k)
    raw, login = F.col("raw_log"), F.col("class_uid").isin(*LOGINS)
    found = lambda v: F.nullif(v, F.lit(""))
    host = F.coalesce(part("hostname"), part("host"))
    user = at("user")
    name = F.coalesce(part("_app"), found(F.regexp_extract(raw, r"\b([A-Za-z][\w.-]*)\[\d+\]", 1)))
    pid = F.coalesce(part("_pid"), found(F.regexp_extract(raw, r"\b[A-Za-z][\w.-]*\[(\d+)\]", 1)))
    near = F.substring(raw, 1, 500)
    uid = F.when(F.contains(near, F.lit("uid=")), found(F.regexp_extract(near, r"\buid=(\d+)", 1)))
    address = F.when(login & at("src_endpoint.ip").isNull(), found(F.regexp_extract(raw, ADDRESS, 1)))
    status = F.when(raw.rlike(FAILED), "Failure").when(raw.rlike(PASSED) | (F.col("class_uid") == 3002), "Success")

    def port(side: str) -> Column:
        ip = at(f"{side}_endpoint.ip")
        behind = F.substring_index(F.substring(raw, F.instr(raw, ip) + F.length(ip), F.lit(8)), "\n", 1)
        number = F.regexp_extract(behind, r"^[:\s]+(\d{1,5})\b", 1).try_cast("int")
        return F.when(F.contains(raw, ip) & number.between(1, 65535), number.cast("string"))

    lacks = lambda k, v: (k, F.when(at(k).isNull(), v))
    extra = [
        lacks("device.hostname", F.when(~host.isin("", "-", "localhost"), host)), lacks("actor.user.name", found(user)), lacks("time", F.when(plausible_time(part("timestamp")), part("timestamp"))),
        lacks("src_endpoint.port", port("src")), lacks("dst_endpoint.port", port("dst")),
        lacks("process.name", F.when(at("process.pid").isNotNull(), name)), lacks("process.pid", F.when(at("process.name").isNotNull(), pid)),
        lacks("actor.user.uid", F.when(user.isNotNull(), uid)), lacks("status", F.when(login, status)), lacks("status_id", F.when(login & at("status").isNull(), F.when(status == "Success", "1").when(status == "Failure", "2"))),
        lacks("src_endpoint.ip", F.when(~address.isin(*NOWHERE), address)),
    ]
    entries = F.array(*(entry(F.lit(k), v) for k, v in extra))
    out = fenced(events, added=as_map(F.filter(entries, lambda e: e["value"].isNotNull())))
    fine = F.map_filter(F.map_concat("event", "added"), lambda k, v: (k != "time") | plausible_time(v))
    return fenced(out, event=fine, confidence=F.map_concat("confidence", F.transform_values("added", lambda k, v: F.lit("enrichment")))).drop("added")


def scrub(events: DataFrame) -> DataFrame:
    """Drops addresses, ports, process and thread numbers that can't be any; hexadecimal ones become decimal."""
    numbered = lambda k: k.endswith(".pid") | k.endswith(".tid")
    typed = lambda k, v: F.when(numbered(k) & v.rlike("^0x[0-9a-fA-F]+$"), F.conv(F.substring(v, 3, 16), 16, 10)).otherwise(v)
    good = lambda k, v: (
        F.when(k.endswith(".ip"), coerce.ip(v).isNotNull()).when(k.endswith(".port"), coerce.port(v).isNotNull()).when(numbered(k), v.rlike(r"^(?:0x[0-9a-fA-F]{1,16}|\d+)$")).otherwise(v.isNotNull())
    )
    out = fenced(events, event=F.transform_values(F.map_filter("event", good), typed))
    number = lambda k: F.element_at("event", k).try_cast("int")
    return fenced(out, activity_id=F.coalesce(number("activity_id"), F.lit(0)), severity_id=F.coalesce(number("severity_id"), F.lit(1)), status_id=number("status_id"), category_uid=F.floor(F.col("class_uid") / 1000).cast("int"))


def json_key_patterns(logs: DataFrame, keys: DataFrame) -> DataFrame:
    """log_id, pattern of every JSON line that has all keys of a pattern, of keys(pattern, key): relational division."""
    own = logs.select("log_id", F.explode(F.map_keys("fields")).alias("key"))
    wanted = keys.distinct()
    sizes = wanted.groupBy("pattern").agg(F.count(F.lit(1)).alias("need"))
    hits = own.join(wanted, "key").groupBy("log_id", "pattern").agg(F.count_distinct("key").alias("have"))
    return hits.join(sizes, "pattern").where("have = need").select("log_id", "pattern")
