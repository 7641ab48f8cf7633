"""Typed Parquet scans and the counted Parquet sink."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Conversions that lose nothing; every other difference in type is an error.
WIDENINGS = {
    "int": ("bigint", "double"),
    "smallint": ("int", "bigint", "double"),
    "tinyint": ("smallint", "int", "bigint", "double"),
    "float": ("double",),
    "date": ("timestamp", "timestamp_ntz"),
}


def coerce_schema(df: DataFrame, schema: T.StructType, permissive: bool = False) -> DataFrame:
    """The schema's columns, found by name in any case and cast explicitly.

    ``permissive`` turns a value that its type cannot hold, junk or too large, into null, so
    that the row can be dropped and counted with those that lack a value. Otherwise it fails
    the job (in ANSI mode).
    """

    def converted(field: T.StructField) -> Column:
        column = F.col(field.name)
        return column.try_cast(field.dataType) if permissive else column.cast(field.dataType)

    return df.select(*[converted(f).alias(f.name) for f in schema.fields])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns, widened where that is lossless; TypeError otherwise."""
    found = {f.name.lower(): f.dataType.simpleString() for f in df.schema.fields}
    problems = []
    for field in schema.fields:
        wanted, actual = field.dataType.simpleString(), found.get(field.name.lower())
        if actual is None:
            problems.append(f"{field.name} is missing")
        elif actual != wanted and wanted not in WIDENINGS.get(actual, ()):
            problems.append(f"{field.name} is {actual}, not {wanted}")
    if problems:
        raise TypeError("; ".join(problems))
    return coerce_schema(df, schema)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet dataset that must fit ``schema``; surplus columns are not read."""
    return conform(spark.read.parquet(path), schema)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Overwrites ``path`` and returns the number of rows, in one job.

    The count is observed in the task that writes, and Spark counts a finished task
    of the last stage once, so retries after lost executors do not inflate it.
    """
    counted, observation = observe(df, {"rows": F.count(F.lit(1))})
    writer = counted.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return observation.get["rows"]


def refresh_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> int:
    """Replaces the partitions of ``path`` that ``df`` has rows for and leaves the others; returns the
    number of rows.

    Rows of a partition are brought together first, so there is about one file for each and not one for
    each task and partition; a partition larger than a task should hold is split again by adaptive
    execution, with those that share its task, and small ones are put together. ``df`` is not sampled, so it runs once. Files are written
    beside the table and moved into it when the job is done: one that fails leaves the old
    partitions as they were, and ``df`` may be read from ``path`` itself. A partition without new rows
    stays, even if it should now be empty. A new path becomes a table of these rows.
    """
    counted, observation = observe(df.hint("rebalance", *partition_by), {"rows": F.count(F.lit(1))})
    writer = counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partition_by).parquet(path)
    return observation.get["rows"]


def write_split(
    df: DataFrame, by: str, kept: str, kept_path: str, rest_path: str
) -> dict[str, int]:
    """Writes rows whose ``by`` is ``kept`` to ``kept_path`` and the others to ``rest_path``, in one job.

    ``kept_path`` has no column ``by``; in ``rest_path`` it is the partition column. Returns the
    number of ``rows`` and of those ``kept``. Everything is written to a folder beside ``kept_path``
    first, and both parts are moved from there once the job is done: one that fails leaves the old
    tables as they were.
    """
    spark = df.sparkSession
    is_kept = F.count_if(F.col(by) == kept)
    observed, observation = observe(df, {"rows": F.count(F.lit(1)), "kept": is_kept})
    parent, _, name = kept_path.rstrip("/").rpartition("/")
    written = f"{parent}/_writing-{uuid.uuid4().hex}-{name}"
    observed.write.partitionBy(by).parquet(written)
    if observation.get["kept"]:
        replace_folder(spark, f"{written}/{by}={kept}", kept_path)
    else:
        spark.createDataFrame([], df.drop(by).schema).write.mode("overwrite").parquet(kept_path)
    replace_folder(spark, written, rest_path)
    return observation.get


def read_rest(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``write_split`` left for ``rest_path``; ``schema`` includes the column split by."""
    # Without rows there is no folder of a partition, only the mark of a finished job.
    return spark.read.schema(schema).parquet(path)


def replace_folder(spark: SparkSession, source: str, target: str) -> None:
    """Moves a folder into the place of another, which goes first if it is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    old, new = hadoop.Path(target), hadoop.Path(source)
    files = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(old, True)
    files.mkdirs(old.getParent())
    if not files.rename(new, old):
        raise OSError(f"could not move {source} to {target}")


def observe(df: DataFrame, metrics: Mapping[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` and the metrics that the next action on it fills in."""
    observation = Observation()
    return df.observe(observation, *[c.alias(n) for n, c in metrics.items()]), observation
