"""Consecutive numbers for key values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderloom.session import staging_path

# monotonically_increasing_id: partition above, row of the partition in the lower bits.
_ROW_BITS = 33


def surrogate_ordinals(df: DataFrame, key: str, name: str = "ordinal") -> DataFrame:
    """Each distinct ``key`` with its position in key order, counted from 0.

    A plain ``row_number()`` over the whole table would sort it in one task. Here the
    distinct keys are range-partitioned and sorted once; a key's number is its row in the
    partition plus the number of keys in the partitions before. Only those offsets, one row
    per partition, are summed in one task, and the keys are not shuffled again.

    Range bounds are sampled, and a second run of the plan may sample others, so the
    numbered keys are written to the shared folder and both branches read the same files.
    """
    spark = df.sparkSession
    path = staging_path(spark, "ordinals")
    (
        df.select(key)
        .distinct()
        .repartitionByRange(key)
        .sortWithinPartitions(key)
        .withColumn("_id", F.monotonically_increasing_id())
        .write.parquet(path)
    )
    keys = spark.read.parquet(path).select(
        key,
        F.shiftright("_id", _ROW_BITS).alias("_part"),
        F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        keys.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    )
    # The broadcast side has one row per shuffle partition.
    return keys.join(F.broadcast(offsets), "_part").select(
        key, (F.col("_offset") + F.col("_row")).cast("bigint").alias(name)
    )
