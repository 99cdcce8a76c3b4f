"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is one aggregation and one join over edges; a node with very many neighbours is combined before the shuffle
and its join rows are split by adaptive execution. No links or labels pass through the driver: only whether some node
still stands in the middle of a path or below two roots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with v < u. Hangs each node's larger (or smaller) neighbours on the least node it knows."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u != v")


def _settled(edges: DataFrame) -> bool:
    """Whether edges are stars: every lower node once, below a node that is below none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 OR below = 1 AND above = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of edges(a long, b long) but the roots themselves."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while not _settled(now):
        after = written(_star(_star(now, True), False).distinct())
        discard(now)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def rooted(rows: DataFrame, roots: DataFrame | None, node: str = "node", root: str = "root") -> DataFrame:
    """rows with the root of each node; a node that roots doesn't name is its own."""
    if roots is None:
        return rows.withColumn(root, F.col(node))
    return rows.join(roots.toDF(node, root), node, "left").withColumn(root, F.coalesce(root, node))


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """node, root of the components that links(a long, b long) add to those of roots: only links between them are followed."""
    if roots is None:
        return written(components(links))
    between = written(rooted(rooted(links, roots, "a", "x"), roots, "b", "y").where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if between.isEmpty():
        return roots
    more = written(components(between))
    out = written(rooted(roots.withColumnRenamed("root", "old"), more, "old").select("node", "root").unionByName(more))
    discard(between, more)
    return out
