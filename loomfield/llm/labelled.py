"""The bounded sample of labelled documents on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id

FOLDS = 5  # rows whose crc32(doc_id as text) is a multiple of this are held out


def held_out(doc_id: Column) -> Column:
    return (crc32_of_id(doc_id) % FOLDS) == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """text, label of at most `most` labelled documents outside the held-out fold, half of them of each class where there are enough.

    The rows are those with the smallest hashes of doc_id, so the sample does not depend on how the input is split.
    Labels that are null, or that stand at a null or unknown doc_id, are left out; of a doc_id's several labels one counts.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = None
    for value in (0, 1):
        part = rows.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
