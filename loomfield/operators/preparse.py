"""Fields of a log line by its format, as a map; formats without a parser give null.

Every layout is matched once: the line is rewritten to its groups with a separator between, and split. Names that begin with
an underscore are header parts; `timestamp` and `hostname` are set where the format has them, by header or by a field.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import fenced

SEP = "\u0001"
# Parts of the layouts below, after the formats' public descriptions (RFC 3164, RFC 5424, CEF, LEEF 1.0, common log format).
_STAMP = r"([A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2})"
_TAG = r"([^\s:\[\]]+?)"
_ELEMENT = r'\[(?:[^\]"\\]|\\.|"(?:[^"\\]|\\.)*")*\]'
LAYOUTS: dict[str, tuple[str, list[str]]] = {
    "syslog_bsd": (rf"^{_STAMP}\s+(\S+)\s+{_TAG}(?:\[(\d+)\])?:\s+(.+)$", ["timestamp", "hostname", "_app", "_pid", "message"]),
    "syslog_rfc3164": (rf"^<(\d{{1,3}})>{_STAMP}\s+(\S+)\s+{_TAG}(?:\[\d+\])?:\s*(.*)$", ["_pri", "timestamp", "hostname", "_app", "message"]),
    "syslog_rfc5424": (rf"^<(\d{{1,3}})>(\d{{1,2}}) (\S+) (\S+) (\S+) (\S+) (\S+) (-|(?:{_ELEMENT})+) ?(.*)$", ["_pri", "_version", "timestamp", "hostname", "_app", "_pid", "_msgid", "_sd", "message"]),
    "cef": (rf"^(?:.*?{_STAMP}\s+(\S+)\s.*?|.*?)CEF:(\d+)" + r"\|((?:[^|\\]|\\.)*)" * 6 + r"\|(.*)$", ["timestamp", "hostname", "_version", "_vendor", "_product", "_dev_version", "_sig_id", "_name", "_severity", "_ext"]),
    "leef": (r"^LEEF:([\d.]+)" + r"\|([^|]*)" * 4 + r"\|(.*)$", ["_version", "_vendor", "_product", "_dev_version", "_event_id", "_ext"]),
    "clf": (r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+(\S+)"\s+(\d+)\s+(\S+).*$', ["src_ip", "ident", "user", "timestamp", "method", "url", "protocol", "status", "size"]),
}
PAIR = r'(\w+)=(?:"([^"]*)"|([^\s,;"]*))'
ADDRESS = r"\b(\d{1,3}(?:\.\d{1,3}){3})\b"
# Keys of a JSON record's time, the first that is there; and of its host.
TIMES, HOSTS = ["timestamp", "time", "ts", "@timestamp", "TimeCreated", "EventTime", "date"], ["Computer", "hostname", "host"]
FLAT = 5  # a nested object of at most this many keys is flattened


def entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def as_map(entries: Column) -> Column:
    """A map of entries of which a later one replaces an earlier one of its key, whatever the session says of such keys."""

    def made(all_: Column) -> Column:
        keys = F.transform(all_, lambda e: e["key"])
        last = F.filter(all_, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), e["key"]))
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), all_).otherwise(last))

    return F.get(F.transform(F.array(entries), made), F.lit(0))


def pairs(text: Column) -> Column:
    """Entries of all key=value pairs, bare or in double quotes."""
    return F.transform(F.regexp_extract_all(text, F.lit(PAIR), F.lit(0)), lambda p: _pair(p, F.lit("'\"")))


def _pair(p: Column, strip: Column) -> Column:
    at = F.instr(p, "=")
    return entry(F.substring(p, F.lit(1), at - 1), F.btrim(F.substring(p, at + 1, F.length(p)), strip))


def spaced_pairs(text: Column) -> Column:
    """Entries of key=value pairs whose values may hold blanks: a value ends where the next key begins; where tabs stand
    between pairs, only there."""
    parts = F.when(F.contains(text, F.lit("\t")), F.split(F.btrim(text), r"\t+")).otherwise(F.split(F.btrim(text), r"\s+(?=\w+=)"))
    kept = F.filter(parts, lambda p: p.rlike(r"^\w+="))
    return F.transform(kept, lambda p: entry(_pair(p, F.lit(" "))["key"], F.regexp_replace(_pair(p, F.lit(" "))["value"], r"\\([=|\\])", "$1")))


def groups(raw: Column, layout: tuple[str, list[str]]) -> Column:
    """Entries of the layout's groups that are there and are not a dash."""
    pattern, names = layout
    parts = F.split(F.regexp_replace(raw, "(?s)" + pattern, SEP.join(f"${k + 1}" for k in range(len(names)))), SEP)
    made = F.zip_with(F.array(*map(F.lit, names)), parts, entry)
    return F.filter(made, lambda e: ~e["value"].isin("", "-"))


def _addresses(text: Column) -> Column:
    """An entry `_ips` of the addresses in a message that names no source."""
    found = F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(1))
    return F.when((F.size(found) > 0) & ~text.rlike(r"\b(?:src_ip|SRC)="), F.array(entry(F.lit("_ips"), F.array_join(found, ","))))


def _with_message(raw: Column, fmt: str) -> Column:
    own, none = groups(raw, LAYOUTS[fmt]), F.array().cast("array<struct<key:string,value:string>>")
    message = F.regexp_replace(raw, "(?s)" + LAYOUTS[fmt][0], f"${len(LAYOUTS[fmt][1])}")
    return F.when(raw.rlike("(?s)" + LAYOUTS[fmt][0]), as_map(F.concat(own, F.coalesce(_addresses(message), none), F.when(F.contains(message, F.lit("=")), pairs(message)).otherwise(none))))


def _with_extension(raw: Column, fmt: str) -> Column:
    extension = F.regexp_replace(raw, "(?s)" + LAYOUTS[fmt][0], f"${len(LAYOUTS[fmt][1])}")
    return F.when(raw.rlike("(?s)" + LAYOUTS[fmt][0]), as_map(F.concat(groups(raw, LAYOUTS[fmt]), spaced_pairs(extension))))


def json_depth(text: Column) -> Column:
    """How deep objects are nested in a JSON text."""
    braces = F.split(F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\\\]++|\\\\.)*+"', ""), "[^{}]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def count(at: Column, c: Column) -> Column:
        now = at["now"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.aggregate(braces, start, count, lambda x: x["most"])


def open_json(text: Column, limit: int | None = FLAT) -> Column:
    """The map of a JSON object: its own keys, and nested objects' keys as dotted paths at any depth.

    An object of more than `limit` keys stays one text. Objects at the top stay as text beside their parts, so that tests of
    top keys see them. Every level is one step over the row's entries, as many as the row is deep.
    """
    parsed = lambda v: F.map_entries(F.from_json(v, "map<string,string>"))
    made = lambda key, value: F.struct(key.alias("key"), value.alias("value"), F.coalesce(value.startswith("{"), F.lit(False)).alias("open"))
    shut = lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"), F.lit(False).alias("open"))

    def opened(x: Column) -> Column:
        inner = F.transform(parsed(x["value"]), lambda c: made(F.concat(x["key"], F.lit("."), c["key"]), c["value"]))
        fits = F.size(inner) >= 1 if limit is None else F.size(inner).between(1, limit)
        return F.when(~x["open"], F.array(x)).when(fits & ~F.contains(x["key"], F.lit(".")), F.concat(F.array(shut(x)), inner)).when(fits, inner).otherwise(F.array(shut(x)))

    first = F.transform(parsed(F.btrim(text)), lambda e: made(e["key"], e["value"]))
    levels = F.when(text.rlike(r"[:,{]\s*\{"), json_depth(text)).otherwise(1)
    rest = F.filter(F.sequence(F.lit(1), F.greatest(levels, F.lit(1))), lambda k: k > 1)
    return as_map(F.transform(F.aggregate(rest, first, lambda all_, _: F.flatten(F.transform(all_, opened))), lambda x: entry(x["key"], x["value"])))


def leaves(text: Column) -> Column:
    """path to value of all of a JSON object's values that aren't objects, at any depth."""
    return F.map_filter(open_json(text, None), lambda k, v: F.from_json(F.when(v.startswith("{"), v), "map<string,string>").isNull())


def preparse(raw: Column, fmt: Column, formats: Iterable[str] | None = None) -> Column:
    """The fields as the line has them; `with_fields` also names time and host. formats: those that occur, where they are known."""
    parsers = {name: (fmt == name, make(raw, name)) for name, make in (("syslog_bsd", _with_message), ("syslog_rfc5424", _with_message), ("syslog_rfc3164", _with_message), ("cef", _with_extension), ("leef", _with_extension))}
    parsers |= {name: (fmt == name, open_json(raw)) for name in ("json", "evtx_json")}
    parsers["kv"] = ((fmt == "kv") & (F.regexp_count(raw, F.lit(PAIR)) >= 2), as_map(pairs(raw)))
    parsers["clf"] = ((fmt == "clf") & raw.rlike(LAYOUTS["clf"][0]), as_map(groups(raw, LAYOUTS["clf"])))
    if formats is None or {"json", "evtx_json"} <= set(formats):  # one branch for both
        parsers |= {"json": (fmt.isin("json", "evtx_json"), open_json(raw))}
        del parsers["evtx_json"]
    out = F.when(F.lit(False), F.create_map().cast("map<string,string>"))
    for name, (test, fields) in parsers.items():
        if formats is None or name in formats:
            out = out.when(test, fields)
    return out


def with_fields(lines: DataFrame, formats: Iterable[str] | None = None) -> DataFrame:
    """lines(…, raw_log, log_format) with fields."""
    raw, fmt, fields = F.col("raw_log"), F.col("log_format"), F.col("fields")
    out, json = fenced(lines, fields=preparse(raw, fmt, formats)), fmt.isin("json", "evtx_json")
    at = lambda names: F.coalesce(*(F.element_at(fields, k) for k in names))
    time = F.when(json, at(TIMES)).when(fmt == "cef", at(["rt", "end"])).when(fmt == "leef", at(["devTime"]))
    host = F.when(json, at(HOSTS)).when(fmt == "cef", at(["dvchost"]))
    extra = F.array(entry(F.lit("timestamp"), time), entry(F.lit("hostname"), host))
    out = fenced(out, __extra=F.filter(extra, lambda e: e["value"].isNotNull()))
    return fenced(out, fields=F.when((F.size("__extra") > 0) & fields.isNotNull(), as_map(F.concat("__extra", F.map_entries(fields)))).otherwise(fields)).drop("__extra")
