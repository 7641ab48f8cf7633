"""Session settings for large runs. The library never creates a session."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

MIB = 1024 * 1024

# Row bytes scanned per shuffle partition. Adaptive execution merges partitions that
# turn out small but never makes more of them, so the first number has to be high enough.
BYTES_PER_PARTITION = 256 * MIB
# What adaptive execution merges to: compressed shuffle bytes of one task. A row takes up to thirty
# times as much in the sorts, joins and aggregates of a task as it does in its shuffle.
SHUFFLE_BYTES_PER_TASK = 16 * MIB
# Blocks of a shuffle per partition that it is sized for, so that there is something to merge.
BLOCKS_PER_PARTITION = 8
# File bytes per scan task, and how many tasks there are before splits grow instead: every
# scan task writes a block for every shuffle partition.
SPLIT_BYTES = 128 * MIB
SCAN_TASKS = 200_000

# Parquet files are a fraction of the size of the rows in them, and rows are what a
# broadcast holds in memory.
ROW_BYTES_PER_FILE_BYTE = 3.0

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join partition even if the aggregate above then needs a shuffle of
    # its own; the shuffle is paid only when a hot partition was in fact found.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows that are split over a few folders are not sorted by folder first.
    "spark.sql.maxConcurrentOutputFileWriters": "8",
    "spark.sql.sources.fileCompressionFactor": str(ROW_BYTES_PER_FILE_BYTE),
}

_UNITS = {"B": 1, "KiB": 1 << 10, "MiB": 1 << 20, "GiB": 1 << 30, "TiB": 1 << 40, "PiB": 1 << 50, "EiB": 1 << 60}


def scan_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the row bytes in a base table, as EXPLAIN COST states it."""
    plan = df.sparkSession.sql("EXPLAIN COST SELECT * FROM {table}", table=df).first()[0]
    size, unit = re.search(r"sizeInBytes=([\d.E+]+) (\w+)", plan).groups()
    return int(float(size) * _UNITS[unit])


def partitions_for(row_bytes: int, parallelism: int) -> int:
    """Shuffle partitions for a job that scans ``row_bytes``; they follow the data at any size."""
    return max(1, parallelism, -(-row_bytes // BYTES_PER_PARTITION))


def split_bytes_for(row_bytes: int) -> int:
    """File bytes per scan task."""
    return max(SPLIT_BYTES, int(row_bytes / ROW_BYTES_PER_FILE_BYTE) // SCAN_TASKS)


def tune(spark: SparkSession, *tables: DataFrame) -> None:
    """Turn on skew handling and size tasks for the base tables about to be read.

    Sizes set by hand stay as they are. Those of an earlier call follow the new tables, up or
    down.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    _size(spark, "spark.sql.adaptive.advisoryPartitionSizeInBytes", f"{SHUFFLE_BYTES_PER_TASK}b")
    if not tables:
        return
    row_bytes = sum(scan_bytes(t) for t in tables)
    parallelism = spark.sparkContext.defaultParallelism
    partitions = partitions_for(row_bytes, parallelism)
    _size(spark, "spark.sql.shuffle.partitions", str(partitions))
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if _by_hand(spark, "spark.sql.shuffle.partitions"):
        if not _by_hand(spark, initial):
            spark.conf.unset(initial)
    else:
        _size(spark, initial, str(max(partitions, -(-BLOCKS_PER_PARTITION * row_bytes // BYTES_PER_PARTITION))))
    _size(spark, "spark.sql.files.maxPartitionBytes", f"{split_bytes_for(row_bytes)}b")


def _size(spark: SparkSession, key: str, value: str) -> None:
    """Sets ``key`` unless someone else did; what was set here is noted beside it."""
    if not _by_hand(spark, key):
        spark.conf.set(key, value)
        spark.conf.set(f"orderloom.tuned.{key}", value)


def _by_hand(spark: SparkSession, key: str) -> bool:
    """Whether ``key`` is set, and not to what ``_size`` noted."""
    explicit = dict(spark.conf.getAll)
    return key in explicit and explicit[key] != explicit.get(f"orderloom.tuned.{key}")


def shared_dir(spark: SparkSession, folder: str | None = None) -> str:
    """A folder every executor sees: the given one, that of ``spark.checkpoint.dir``, or else one
    in the session's warehouse."""
    chosen = folder or spark.conf.get("spark.checkpoint.dir", None)
    return (chosen or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/staging").rstrip("/")


def staging_path(spark: SparkSession, name: str, folder: str | None = None) -> str:
    """A new path for ``name`` in the shared folder."""
    return f"{shared_dir(spark, folder)}/orderloom-{uuid.uuid4().hex}/{name}"
