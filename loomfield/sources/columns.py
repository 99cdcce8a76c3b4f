"""Parquet columns from event maps: the union of the keys seen, and a sink whose columns may grow from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_COLUMNS = 2_000


def keys_of(events: DataFrame, column: str = "event") -> list[str]:
    """All keys of a map column, sorted: one small aggregation. More than `MOST_COLUMNS` are an error, not a cut."""
    rows = events.select(F.explode(F.map_keys(column)).alias("key")).distinct().orderBy("key").limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} keys in {column}")
    return [r["key"] for r in rows]


def flattened(events: DataFrame, column: str = "event") -> DataFrame:
    """events with a column for each key of the map, instead of it. Names that events has already get the map's name before them."""
    other = [c for c in events.columns if c != column]
    taken = {c.lower() for c in other}
    named = {k: f"{column}.{k}" if k.lower() in taken else k for k in keys_of(events, column)}
    return events.select(*(F.col(f"`{c}`") for c in other), *(F.element_at(column, k).alias(n) for k, n in named.items()))


def append_columns(events: DataFrame, path: str, column: str = "event") -> None:
    """Appends a batch with its own set of columns; older files keep theirs."""
    flattened(events, column).write.mode("append").parquet(path)


def read_columns(spark: SparkSession, path: str) -> DataFrame:
    """All batches as one table: the union of their columns, null where a batch had none."""
    return spark.read.option("mergeSchema", True).parquet(path)
