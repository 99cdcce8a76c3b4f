"""Steps of a wide projection that the optimiser keeps apart, and the settings that they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A projection of hundreds of expressions makes methods that the JVM doesn't compile; beyond the limit Spark evaluates it by
# smaller ones. Constraints inferred from such columns are as large again.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000", "spark.sql.constraintPropagation.enabled": "false"}


def tuned(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if its files give fewer."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fenced(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each computed once for a row: filters and projections aren't moved across the row number, so the
    optimiser doesn't copy an expression into every place that uses its column."""
    return df.withColumns(columns | {"__fence": F.monotonically_increasing_id()}).where("__fence >= 0").drop("__fence")
