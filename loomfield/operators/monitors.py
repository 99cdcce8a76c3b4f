"""Monitors: issues that aren't raised again while one is open."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def raised(events: DataFrame, key: list[str], time: str, order: str, hold_seconds: float) -> DataFrame:
    """The events that raise an issue: no issue of their key was raised in the hold_seconds before (or just as long ago).

    Events are dealt by key, sorted by time and folded batch by batch: a key's state is the time of its last issue. Events
    without a time raise nothing; a null in a key is a key like others.
    """
    names = [f"`{c.replace('`', '``')}`" for c in events.columns]
    own = [F.col(k).alias(f"k{i}") for i, k in enumerate(key)]
    rows = events.where(F.col(time).isNotNull()).select(F.struct(*names).alias("row"), *own, F.col(time).cast("timestamp").cast("double").alias("t"), F.col(order).alias("ord"))
    keys = [f"k{i}" for i in range(len(key))]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "t", "ord")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, 0.0
        for batch in batches:
            keep = []
            for own, t in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column("t").to_pylist(), strict=True):
                opens = own != now or t - last > hold_seconds
                if opens:
                    now, last = own, t
                keep.append(opens)
            yield batch.select(["row"]).filter(pa.array(keep, pa.bool_()))

    kept = rows.mapInArrow(run, StructType([rows.schema["row"]]))
    return kept.select(*(F.col(f"row.{n}").alias(c) for n, c in zip(names, events.columns, strict=True)))
