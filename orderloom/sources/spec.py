"""Where an entity comes from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from orderloom.sources.jdbc import JdbcConnection, Partitioning, read_jdbc
from orderloom.sources.parquet import coerce_schema
from orderloom.sources.text import read_text


@dataclass(frozen=True)
class Source:
    """``kind`` is "file" (needs ``path``) or "jdbc" (needs ``connection`` and ``dbtable``)."""

    kind: str
    path: str | None = None
    connection: JdbcConnection | None = None
    dbtable: str | None = None
    partitioning: Partitioning | None = None


def read_source(spark: SparkSession, source: Source, schema: T.StructType) -> DataFrame:
    """The source's rows in ``schema``. A JDBC row may still lack required values: values that
    its type cannot hold are null."""
    if source.kind == "file":
        if source.path is None:
            raise ValueError("a file source needs a path")
        return read_text(spark, source.path, schema)
    if source.kind == "jdbc":
        if source.connection is None or source.dbtable is None:
            raise ValueError("a jdbc source needs a connection and a dbtable")
        rows = read_jdbc(spark, source.connection, source.dbtable, source.partitioning)
        return coerce_schema(rows, schema, permissive=True)
    raise ValueError(f"unknown source kind: {source.kind!r}")
