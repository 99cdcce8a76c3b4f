"""Sharding by vector bin packing: bytes, words and rows of every shard near equal, copies of a text together.

A group is all rows of one text; its vector is (bytes, words, rows). Groups are placed in falling order of size, each in
the shard where the dot product of its vector with the shard's residual capacity is highest.

* Groups above 1 / (`FINE` * shards) of the total in any dimension number at most 3 * FINE * shards, whatever the input;
  they are packed on the driver. A group stays whole unless it alone exceeds a shard's share of the total in some
  dimension (one text may be a third of all rows): such a group is cut, by a hash of doc_id, into pieces of 1 / `COARSE`
  of a share at most, as pieces of a whole share leave no room to balance the other dimensions.
* All others are dealt by hash into cells of about `CELL` groups; each cell is packed by itself, by one task, into what
  the heavy groups have left of every shard, in proportion. A cell holds a row for each group, not its members, so it is
  bounded. Errors of a cell are at most a small group each and don't add up in one shard.

Words are `[^\x20\x09-\x0D]+`. Null text: 0 bytes, no words, size 1, and a group of its own. Empty and very long texts are
groups like others. Null or repeated doc_ids: rows are placed like any others; rows alike in everything stand next to each
other, and ties of size fall by the text's hash. Empty table: empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_RE, discard, documents, written

SHARDS, FINE, COARSE, CELL = 16, 64, 8, 16_384


def place(vectors: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The shard of each vector (items, dimensions), largest first, by dot product with residual capacity (shards, dimensions)."""
    scale = np.maximum(capacity.sum(0), 1e-9)
    items, left = vectors / scale, capacity / scale
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-items.max(1, initial=0), kind="stable"):
        out[i] = shard = int(np.argmax(left @ items[i]))
        left[shard] -= items[i]
    return out


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, words, shard, slot of every row."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = written(docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.regexp_count(text, F.lit(WORD_RE["space"] + "+")).cast("long").alias("words"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.col("text").isNull()).alias("key"),
    ).withColumn("salt", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32"))))
    sums = [F.sum("size").alias("size"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("n")]
    groups = written(rows.groupBy("key").agg(*sums))
    total = np.array([float(x or 0) for x in groups.agg(F.sum("size"), F.sum("words"), F.sum("n")).first()])
    quantum = np.maximum(total / (FINE * shards), 1.0)
    over = (F.col("size") > float(quantum[0])) | (F.col("words") > float(quantum[1])) | (F.col("n") > float(quantum[2]))
    heavy = groups.where(over).orderBy("key").collect()  # at most 3 * FINE * shards groups
    vectors = np.array([[g["size"], g["words"], g["n"]] for g in heavy], float).reshape(-1, 3)
    shares = (vectors / np.maximum(total / shards, 1.0)).max(1, initial=0)
    cuts = np.where(shares > 1, np.minimum(np.ceil(shares * COARSE), vectors[:, 2]), 1).astype(np.int64)
    parts = np.repeat(vectors / np.maximum(cuts, 1)[:, None], cuts, axis=0)
    capacity = np.tile(total / shards, (shards, 1))
    homes = place(parts, capacity)
    np.subtract.at(capacity, homes, parts)
    where = np.split(homes, np.cumsum(cuts)[:-1]) if len(heavy) else []
    table = spark.createDataFrame([(g["key"], [int(x) for x in w]) for g, w in zip(heavy, where, strict=True)], "key long, places array<int>")
    share = np.maximum(capacity, 0)
    share = np.where(share.sum(0) > 0, share / np.maximum(share.sum(0), 1e-9), 1 / shards)
    cells = max(1, -(-groups.where(~over).count() // CELL))

    def pack(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values("key")
        vectors = cell[["size", "words", "n"]].to_numpy(float)
        return pd.DataFrame({"key": cell["key"], "home": place(vectors, share * vectors.sum(0)).astype(np.int32)})

    packed = written(groups.where(~over).withColumn("cell", F.pmod("key", F.lit(cells))).groupBy("cell").applyInPandas(pack, "key long, home int"))
    marked = rows.join(F.broadcast(table), "key", "left")
    piece = F.pmod("salt", F.size("places").cast("long")).cast("int")
    placed = marked.where("places is not null").withColumn("shard", F.element_at("places", piece + 1)).drop("places", "key")
    light = marked.where("places is null").join(packed, "key").withColumn("shard", F.col("home")).drop("places", "key", "home")
    buckets = max(1, -(-int(total[2]) // CELL))
    both = written(light.unionByName(placed).withColumn("bucket", F.pmod("salt", F.lit(buckets))))
    discard(rows, groups, packed)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = both.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inner = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size"))
    return both.withColumn("inner", inner).join(offsets, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", "words", "shard", (F.col("offset") + F.col("inner") - 1).cast("long").alias("slot"))


def op1_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign(documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
