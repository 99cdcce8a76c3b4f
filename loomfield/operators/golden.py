"""Golden entries: events whose fields can be trusted, by gates that are averaged to a trust score.

Gates: values stand in the line; the schema has no errors (else rejected); typed values are valid; enough fields (else
rejected); the line is not among the known entries (else rejected); the time is of 2000 to 2030; the fields fit together.
Only fields that a pattern or a known name gave count. Everything is one projection over the events and an anti-join with
the known lines by their first 200 characters; a row says which gate rejected it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce, network
from .schemas import validate
from .staging import fenced

LEAST_FIELDS, TRUST = 3, 0.8
# Fields that aren't taken from the line; origins of values that needn't stand in it; values that are defaults.
METADATA = ["class_uid", "class_name", "category_uid", "category_name", "activity_id", "activity_name", "severity_id", "severity", "type_uid", "type_name", "status_id"]
EXEMPT = ["static", "default", "enrichment"]
DEFAULTS = ["unknown", "Unknown", "UNKNOWN", "N/A", "n/a", "NA", "none", "None", "Security Finding", "Base Event", "Base Event (low confidence)"]


def in_line(value: Column, raw: Column) -> Column:
    """Whether a value can be found in its line: one character always, else as text without case, a decimal by its whole part, a truth value by its words."""
    low = F.lower(raw)
    words = lambda all_: F.exists(F.array(*map(F.lit, all_)), lambda w: F.contains(low, w))
    whole = F.when(value.rlike(r"^-?\d+\.\d+$"), F.contains(raw, F.substring_index(value, ".", 1)))
    truth = F.when(value == "true", words(coerce.TRUE)).when(value == "false", words(coerce.FALSE))
    return (F.length(value) <= 1) | F.contains(low, F.lower(value)) | F.coalesce(whole, F.lit(False)) | F.coalesce(truth, F.lit(False))


def invented(events: DataFrame) -> DataFrame:
    """events with `invented`: the fields whose values aren't in the line, and those that are known defaults; metadata and exempt origins aside."""
    leaf = lambda k: F.substring_index(k, ".", -1)
    judged = lambda k: ~leaf(k).isin(METADATA) & ~F.coalesce(F.element_at("confidence", k), F.lit("")).isin(EXEMPT)
    bad = lambda k, v: judged(k) & (v.isin(DEFAULTS) | ~in_line(v, F.col("raw_log")))
    return fenced(events, invented=F.map_filter("event", bad))


def typed(key: Column, value: Column) -> Column:
    """Whether a value is of its path's type; null where the path has none."""
    return (
        F.when(key.endswith(".ip"), network.ip_key(value).isNotNull()).when(key.endswith(".port"), coerce.port(value).isNotNull())
        .when(key.endswith(".pid") | key.endswith("_id") | key.endswith("_uid"), value.rlike(r"^\d+$")).when(key.endswith(".mac"), coerce.mac(value).isNotNull())
    )


def timely(value: Column) -> Column:
    """A time of 2000 to 2030; one that begins with letters has no year to judge."""
    number, year = value.try_cast("double"), F.year(F.try_to_timestamp(F.replace(value, F.lit("Z"), F.lit("+00:00"))))
    return F.when(number.isNotNull(), number.between(946_684_800, 1_924_991_999)).when(year.isNotNull(), year.between(2000, 2030)).otherwise((F.length(value) < 20) & value.rlike("^[A-Za-z]{3}"))


def coherence(event: Column, class_uid: Column) -> Column:
    """The share of checks passed that apply: who, where or what by category; status and its number; severity in range."""
    has = lambda name: F.exists(F.map_keys(event), lambda k: (k == name) | k.startswith(f"{name}."))
    at = lambda k: F.element_at(event, k)
    category, status, severity = F.floor(class_uid / 1000), F.lower(at("status")), at("severity_id").try_cast("int")
    clash = (status.isin("failure", "failed") & (at("status_id") == "1")) | (status.isin("success", "succeeded") & (at("status_id") == "2"))
    checks = F.array(
        F.when(category == 3, has("user") | has("actor.user")), F.when(category == 4, has("src_endpoint") | has("dst_endpoint")), F.when(category == 2, has("finding_info") | has("message")),
        F.when(at("activity_id").isNotNull(), ~F.coalesce(clash, F.lit(False))), F.when(severity.isNotNull(), severity.between(0, 6) | (severity == 99)),
    )
    own = F.array_compact(checks)
    return F.when(F.size(own) == 0, 1.0).otherwise(F.size(F.filter(own, lambda x: x)) / F.size(own))


def line_key(raw: Column) -> Column:
    return F.trim(F.substring(raw, 1, 200))


def candidates(events: DataFrame, schemas: DataFrame, known: DataFrame, least: int = LEAST_FIELDS, trust: float = TRUST) -> DataFrame:
    """events(raw_log, class_uid, event, confidence, …) with expected (path to value), gates, trust, rejected (null: golden)."""
    from_line = F.map_filter("event", lambda k, v: F.element_at("confidence", k).isin("pattern", "alias"))
    none = F.create_map().cast("map<string,string>")
    out = fenced(events, event=F.coalesce("event", none), confidence=F.coalesce("confidence", none))
    out = fenced(out, __all=from_line)
    out = fenced(out, expected=F.map_filter("__all", lambda k, v: F.substring_index(k, ".", -1).isin(METADATA) | in_line(v, F.col("raw_log"))))
    out = validate(out, schemas)
    checks = F.array_compact(F.transform(F.map_entries("expected"), lambda e: typed(e["key"], e["value"])))
    time = F.coalesce(F.element_at("expected", "time"), F.element_at("event", "time"))
    count = F.size("expected")
    out = fenced(out, gates=F.struct(
        F.when(F.size("__all") > 0, count / F.size("__all")).otherwise(0.0).alias("in_line"), F.when(F.col("valid"), 1.0).otherwise(0.0).alias("schema"),
        F.when(F.size(checks) > 0, F.size(F.filter(checks, lambda x: x)) / F.size(checks)).otherwise(1.0).alias("types"), F.least(count / least, F.lit(1.0)).alias("fields"), F.lit(1.0).alias("new"),
        F.when(time.isNull(), 0.8).when(timely(time), 1.0).otherwise(0.0).alias("time"), coherence(F.col("event"), F.col("class_uid")).alias("coherence"),
    ))
    names = ["in_line", "schema", "types", "fields", "new", "time", "coherence"]
    old = known.select(line_key(F.col("raw_log")).alias("__key"), F.lit(True).alias("__known")).distinct()
    out = out.withColumns({"trust": sum((F.col(f"gates.{n}") for n in names), F.lit(0.0)) / len(names), "__key": line_key(F.col("raw_log"))}).join(old, "__key", "left")
    rejected = F.when(~F.col("valid"), "schema").when(count < least, "fields").when(F.col("__known"), "known").when(F.col("trust") < trust, "trust")
    return out.withColumn("rejected", rejected).drop("__all", "__key", "__known")
