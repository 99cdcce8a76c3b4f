"""A cache of what was learned from JSON lines: key fingerprint and class to a field map, applied before any pattern.

A template's field map is found by values: the event's values and the line's values, both exploded, are joined where equal;
of several JSON fields with a value the first in the document counts, of several paths at one field the last by name. Only
the first event of each new (fingerprint, class) is taken apart, so the join is as large as the new templates.

The cache is a table of versions in one folder: a version is a partition, appended whole, and readers take the latest. Each
holds `MOST` templates at most, those of least (confidence, last hit) having gone, so it can be broadcast at any input size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import saved
from .learn import fingerprint
from .preparse import as_map, entry, leaves
from .rules import best_rows

MOST, USABLE = 10_000, 0.3
META = ["class_uid", "class_name", "category_uid", "category_name", "activity_id", "severity_id"]
COLUMNS = "fingerprint string, class_uid int, class_name string, field_map map<string,string>, static map<string,string>, hits long, passes long, fails long, created double, last_hit double"


def keys_of(raw: Column) -> Column:
    """The fingerprint of a line's top keys, as far as it is a JSON object."""
    return fingerprint(F.from_json(F.btrim(raw), "map<string,string>"))


def confidence() -> Column:
    """The share of passes (0.5 where nothing was validated) times hits / 10, 1 at most."""
    checked = F.col("passes") + F.col("fails")
    share = F.when(checked > 0, F.col("passes") / checked * F.least(F.col("hits") / 10, F.lit(1.0))).otherwise(0.5)
    return F.when(F.col("hits") > 0, share).otherwise(0.0)


def promotable() -> Column:
    return (F.col("hits") >= 3) & (confidence() >= 0.8) & (F.col("passes") >= 2)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], COLUMNS)


def learn(events: DataFrame, cache: DataFrame, time: str, order: str, valid: Column | None = None) -> DataFrame:
    """The cache after events(raw_log, class_uid, class_name, event): known templates get hits and validations, new ones a field map."""
    valid = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    own = events.where(F.btrim("raw_log").startswith("{")).select(
        keys_of(F.col("raw_log")).alias("fingerprint"), F.col("class_uid").cast("int").alias("class_uid"), "class_name", "event", "raw_log",
        F.col(time).cast("timestamp").cast("double").alias("at"), F.col(order).alias("ord"), valid.alias("valid"),
    ).where("fingerprint IS NOT NULL AND event IS NOT NULL")
    own = saved(own)  # read several times below, and joined by what was computed
    key = ["fingerprint", "class_uid"]
    counts = own.groupBy(*key).agg(F.count(F.lit(1)).alias("hits"), F.count_if("valid").alias("passes"), F.count_if(~F.col("valid")).alias("fails"), F.min("at").alias("created"), F.max("at").alias("last_hit"))
    fresh = own.join(F.broadcast(cache.select(*key)), key, "left_anti")
    first = best_rows(fresh, key, [F.asc("ord"), F.asc("raw_log")]).drop("rank")
    wanted = F.map_filter("event", lambda k, v: ~k.isin(META) & v.isNotNull() & (v != "unknown"))
    paths = first.select(*key, F.explode(wanted).alias("path", "value"))
    sources = first.select(*key, F.posexplode(F.map_entries(leaves(F.col("raw_log")))).alias("place", "e")).select(*key, "place", F.col("e.key").alias("source"), F.col("e.value").alias("value"))
    found = paths.join(sources, [*key, "value"]).groupBy(*key, "path").agg(F.min_by("source", "place").alias("source"))
    found = found.groupBy(*key, "source").agg(F.max("path").alias("path")).groupBy(*key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "path")))).alias("field_map"))
    none = F.create_map().cast("map<string,string>")
    made = first.select(*key, "class_name", F.map_filter("event", lambda k, v: k.isin(META)).alias("static")).join(found, key, "left").withColumn("field_map", F.coalesce("field_map", none))
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    new = counts.join(made, key).select(*names)
    more = counts.select(*key, *(F.col(c).alias(f"_{c}") for c in ("hits", "passes", "fails", "last_hit")))
    old = cache.select(*names).join(more, key, "left")
    old = old.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in ("hits", "passes", "fails")} | {"last_hit": F.greatest("last_hit", "_last_hit")}).select(*names)
    return old.unionByName(new)


def evicted(cache: DataFrame, most: int = MOST) -> DataFrame:
    """The `most` templates of highest confidence, then latest hit."""
    return cache.withColumn("__c", confidence()).orderBy(F.desc("__c"), F.desc("last_hit"), "fingerprint", "class_uid").limit(most).drop("__c")


def save_version(cache: DataFrame, folder: str, most: int = MOST) -> int:
    """Appends the cache as the folder's next version, and gives its number."""
    spark = cache.sparkSession
    version = (latest(spark, folder) or 0) + 1
    evicted(cache, most).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(folder)
    return version


def latest(spark: SparkSession, folder: str) -> int | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(f"{COLUMNS}, version int").parquet(folder).agg(F.max("version")).first()[0]
    except AnalysisException:  # no such folder yet
        return None


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The latest version of a folder's cache; an empty one where there is none."""
    version = latest(spark, folder)
    return empty(spark) if version is None else spark.read.schema(f"{COLUMNS}, version int").parquet(folder).where(F.col("version") == version).drop("version")


def apply(lines: DataFrame, cache: DataFrame, most: int = MOST) -> DataFrame:
    """lines(raw_log, class_uid, …) with cached, cached_event (path to text) and cached_class of the usable template of their keys and class.

    Fixed values first, then the values at the mapped fields, the template's class last. Where lines have no class yet, the
    class of null matches every class of the fingerprint, of which the one with most hits counts.
    """
    usable = evicted(cache, most).where(confidence() >= USABLE)
    one = best_rows(usable, ["fingerprint"], [F.desc("hits"), F.asc("class_uid")]).withColumn("asked", F.lit(None).cast("int"))
    table = usable.withColumn("asked", F.col("class_uid")).unionByName(one.drop("rank")).select(F.col("fingerprint").alias("__fp"), F.col("asked").alias("__asked"), F.struct("class_uid", "class_name", "field_map", "static").alias("__t"))
    keyed = lines.withColumn("__key", F.when(F.btrim("raw_log").startswith("{"), keys_of(F.col("raw_log"))))
    out = keyed.join(F.broadcast(table), (F.col("__key") == F.col("__fp")) & F.col("class_uid").eqNullSafe(F.col("__asked")), "left")  # 2 * MOST rows at most
    values = F.when(F.col("__t").isNotNull(), leaves(F.col("raw_log")))
    mapped = F.filter(F.transform(F.map_entries("__t.field_map"), lambda e: entry(e["value"], F.element_at("__v", e["key"]))), lambda e: e["value"].isNotNull())
    out = out.withColumn("__v", values)
    fixed = F.map_entries("__t.static")
    own = F.array(entry(F.lit("class_uid"), F.col("__t.class_uid").cast("string")), entry(F.lit("class_name"), F.col("__t.class_name")))
    event = as_map(F.filter(F.concat(fixed, mapped, own), lambda e: e["value"].isNotNull()))
    return out.withColumns({"cached": F.col("__t").isNotNull(), "cached_event": event, "cached_class": F.col("__t.class_uid")}).drop("__key", "__fp", "__asked", "__t", "__v")


def stats(cache: DataFrame, looked_up: int, hits: int) -> DataFrame:
    """size, hits, misses, hit_rate, promotable (number) and promotable_pct of a cache."""
    out = cache.agg(F.count(F.lit(1)).alias("size"), F.count_if(promotable()).alias("promotable"))
    rate = hits / looked_up if looked_up else 0.0
    return out.select("size", F.lit(hits).cast("long").alias("hits"), F.lit(looked_up - hits).cast("long").alias("misses"), F.lit(rate).alias("hit_rate"), "promotable", (100 * F.col("promotable") / F.greatest("size", F.lit(1))).alias("promotable_pct"))
