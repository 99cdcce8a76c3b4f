"""The tier cascade: each tier sees only the lines that the tiers before left over.

Tier 0 is the cache, 1 the pattern library and known names, then line templates (reported as tier 1, method `template`), then
whatever costly steps the caller gives. A tier's result is written before the next reads what it left, so the leftover is a
filter on a stored flag: no tier's expressions are evaluated for lines that an earlier one took, and lines need no unique id
for an anti-join. What the tiers after the cache took from JSON lines is learned for the next run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import saved
from . import cache as caches
from .library import Library
from .normalize import normalize
from .templates import extract

ENOUGH = 3  # fields that a template must give
RESULT = ["tier", "method", "class_uid", "event"]


def cascade(
    logs: DataFrame, order: str, time: str, cache: DataFrame, library: Library | None = None, templates: DataFrame | None = None,
    costly: list[tuple[int, str, Callable[[DataFrame], DataFrame]]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(logs(raw_log, …) with tier, method, class_uid and event; the cache after it). Lines that no tier takes have tier null.

    costly: (tier, method, function of the leftover lines that adds class_uid and event, null where it finds nothing).
    """
    names, parts = logs.columns, []

    def settle(tried: DataFrame, taken, tier: int, method: str) -> DataFrame:
        """Keeps what was taken, and gives the lines that are left."""
        stored = saved(tried.withColumn("__taken", F.coalesce(taken, F.lit(False))).select(*names, "__taken", "class_uid", "class_name", "event"))
        parts.append(stored.where("__taken").select(*names, F.lit(tier).alias("tier"), F.lit(method).alias("method"), F.col("class_uid").cast("int").alias("class_uid"), "class_name", "event"))
        return stored.where("NOT __taken").select(*names)

    asked = caches.apply(logs.withColumn("class_uid", F.lit(None).cast("int")), cache)
    asked = asked.drop("class_uid").withColumns({"class_uid": F.col("cached_class"), "class_name": F.element_at("cached_event", "class_name"), "event": F.col("cached_event")})
    rest = settle(asked, F.col("cached"), 0, "cache")
    normal = normalize(rest, library)
    rest = settle(normal, F.col("pattern").isNotNull() | (F.size(F.map_filter("confidence", lambda k, v: v == "alias")) >= ENOUGH), 1, "pattern")
    unclassed = {"class_uid": F.lit(0), "class_name": F.lit("Base Event")}
    if templates is not None:
        mined = extract(rest, templates).withColumns(unclassed | {"event": F.map_concat(F.create_map(F.lit("activity_id"), F.lit("0"), F.lit("severity_id"), F.lit("1")), "template_fields")})
        rest = settle(mined, F.size("template_fields") >= ENOUGH, 1, "template")
    for tier, method, step in costly or ():
        tried = step(rest)
        tried = tried if "class_name" in tried.columns else tried.withColumn("class_name", F.lit(None).cast("string"))
        rest = settle(tried, F.col("event").isNotNull(), tier, method)
    left = rest.withColumns({"tier": F.lit(None).cast("int"), "method": F.lit(None).cast("string"), "class_uid": F.lit(0), "class_name": F.lit("Base Event"), "event": F.lit(None).cast("map<string,string>")})
    done = parts[0]
    for part in parts[1:]:
        done = done.unionByName(part)
    learned = caches.evicted(caches.learn(done.where("tier > 0 AND method != 'template'"), cache, time, order))
    return done.unionByName(left).select(*names, *RESULT), saved(learned)
