"""What can be learned from normalised lines: key fingerprints, masked templates, verified field maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(fields: Column) -> Column:
    """The first twelve sorted keys, joined by bars."""
    return F.array_join(F.slice(F.array_sort(F.map_keys(fields)), 1, 12), "|")


def fingerprints(events: DataFrame, passed: Column) -> DataFrame:
    """One row for each (fingerprint, class): hits, passes, fails, confidence, promotable.

    Confidence is the share of passes times hits / 10, at most; 0.5 for the share where nothing was validated.
    """
    out = events.groupBy(fingerprint(F.col("fields")).alias("fingerprint"), "class_uid").agg(F.count(F.lit(1)).alias("hits"), F.count_if(passed).alias("passes"), F.count_if(~passed).alias("fails"))
    checked = F.col("passes") + F.col("fails")
    out = out.withColumn("confidence", F.when(checked > 0, F.col("passes") / checked).otherwise(0.5) * F.least(F.col("hits") / 10, F.lit(1.0)))
    return out.withColumn("promotable", (F.col("hits") >= 3) & (F.col("confidence") >= 0.8) & (F.col("passes") >= 2))


def mask_templates(logs: DataFrame, least: int = 2) -> DataFrame:
    """template, cluster_size: lines with every token that holds a digit as a slot."""
    masked = F.regexp_replace("raw_log", r"(?<![^ ])[^ 0-9]*[0-9][^ ]*", "<*>")
    return logs.groupBy(masked.alias("template")).agg(F.count(F.lit(1)).alias("cluster_size")).where(F.col("cluster_size") >= least)


def learned_fields(events: DataFrame, least: int = 3) -> DataFrame:
    """events with verified, a map of path to value of aliased and extracted fields that stand in the line, and n_fields; only those with enough."""
    stands = lambda k, v: F.contains(F.col("raw_log"), v) & F.element_at("confidence", k).isin("alias", "pattern") & ~k.isin("activity_id", "status_id", "severity_id", "status", "auth_protocol")
    out = events.withColumn("verified", F.map_filter("event", stands))
    return out.withColumn("n_fields", F.size("verified")).where(F.col("n_fields") >= least)
