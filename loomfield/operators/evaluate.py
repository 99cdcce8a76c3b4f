"""Evaluation of normalised events: accuracy against the truth, suspected labels, observables, the cache; and the class gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import ABSENT, best_rows, observable_type, observables
from .triage import same_value

GATE, TOP, EXAMPLES, SAMPLE, DISAGREE = 0.3, 10, 3, 500, 5
NO_CLASS, UNSURE = "Base Event", "Base Event (low confidence)"


def gated(class_uid: Column, class_name: Column, confidence: Column, least: float = GATE) -> tuple[Column, Column, Column]:
    """(class_uid, class_name, confidence) after the gate: without a class the base event at 0, below `least` the unsure base event."""
    none, low = class_uid.isNull(), confidence < least
    return (
        F.when(none | low, 0).otherwise(class_uid), F.when(none, NO_CLASS).when(low, UNSURE).otherwise(class_name), F.when(none, 0.0).otherwise(confidence),
    )


def back_filled(class_uid: Column, class_name: Column, event: Column) -> tuple[Column, Column]:
    """An unsure base event takes the class that its event names; where there was no classifier it stays."""
    own = F.element_at(event, "class_uid").try_cast("int")
    take = (class_uid == 0) & (class_name != NO_CLASS) & (F.coalesce(own, F.lit(0)) != 0)
    return F.when(take, own).otherwise(class_uid), F.when(take, F.coalesce(F.element_at(event, "class_name"), class_name)).otherwise(class_name)


def compared(events: DataFrame, truth: DataFrame, on: str) -> DataFrame:
    """on, path, expected, got, same of every expected field of truth(on, expected map); an event that is missing gets nothing right.

    The event's map goes through the join by its id, so write events that are the result of a wide projection first.
    """
    wanted = truth.select(on, F.explode("expected").alias("path", "wanted"))
    own = wanted.join(events.select(on, "event"), on, "left").withColumn("got", F.element_at("event", F.col("path")))
    return own.select(on, "path", F.col("wanted").alias("expected"), "got", same_value(F.col("wanted"), F.col("got")).alias("same"))


def accuracy(pairs: DataFrame, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """(one row: n, n_same, score; the `top` paths with most mismatches: path, mismatches, and the first examples by expected value)."""
    whole = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("n_same")).withColumn("score", F.when(F.col("n") > 0, 100 * F.col("n_same") / F.col("n")).otherwise(0.0))
    wrong = pairs.where("NOT same").groupBy("path", "expected", "got").agg(F.count(F.lit(1)).alias("n"))
    example = F.struct("expected", "got")
    # Examples are the least few of each path: ranked before they are gathered, so no list is longer.
    few = best_rows(wrong, ["path"], [F.asc("expected"), F.asc_nulls_first("got")], EXAMPLES)
    few = few.groupBy("path").agg(F.sort_array(F.collect_list(example)).alias("examples"))
    worst = wrong.groupBy("path").agg(F.sum("n").alias("mismatches")).orderBy(F.desc("mismatches"), "path").limit(top)
    return whole, worst.join(few, "path")


def suspected_labels(pairs: DataFrame, on: str, most: int = SAMPLE, disagree: int = DISAGREE) -> DataFrame:
    """on, n_wrong of at most `most` records, those of least hash, in which at least `disagree` expected fields differ."""
    rows = pairs.groupBy(on).agg(F.count_if(~F.col("same")).alias("n_wrong")).orderBy(F.xxhash64(on), on).limit(most)
    return rows.where(F.col("n_wrong") >= disagree)


def observables_score(events: DataFrame) -> DataFrame:
    """eligible (present observable paths), built (after removing repeats), score of events(event)."""
    eligible = F.size(F.map_filter("event", lambda k, v: observable_type(k).isNotNull() & ~v.isin(ABSENT)))
    out = events.select(eligible.alias("e"), F.size(observables(F.col("event"))).alias("b")).agg(F.coalesce(F.sum("e"), F.lit(0)).alias("eligible"), F.coalesce(F.sum("b"), F.lit(0)).alias("built"))
    return out.withColumn("score", F.when(F.col("eligible") > 0, 100 * F.col("built") / F.col("eligible")).otherwise(0.0))


def cache_quality(stats: DataFrame) -> DataFrame:
    """score of `cache.stats`: 40 % hit rate, 30 % size up to ten templates, 30 % share of promotable ones."""
    share = F.when(F.col("size") > 0, F.col("promotable") / F.col("size")).otherwise(0.0)
    score = 40 * F.col("hit_rate") + 30 * F.least(F.col("size") / 10, F.lit(1.0)) + 30 * share
    return stats.withColumn("score", F.round(score, 1))
