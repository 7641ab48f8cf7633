"""JDBC scans."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from orderloom.entities import Entity


@dataclass(frozen=True)
class JdbcConnection:
    url: str
    user: str
    password: str = field(repr=False)
    driver: str = "org.postgresql.Driver"


@dataclass(frozen=True)
class JdbcPartitioning:
    """Splits a scan into ranges of a numeric, date or timestamp column.

    The bounds only place the cuts; rows outside them are read too.
    """

    column: str
    lower: str
    upper: str
    partitions: int


@dataclass(frozen=True)
class JdbcRanges:
    """Ranges of a column whose bounds the database is asked for, by one query."""

    column: str
    partitions: int


@dataclass(frozen=True)
class JdbcHashes:
    """Splits a scan by a hash of any column, for keys that have no even order, such as text.

    ``expression`` is the database's hash as an integer, with ``{column}`` for the quoted column. It
    must depend on the value alone. The default is that of PostgreSQL. The database
    evaluates it for every row of every task, so ranges of an indexed column are cheaper.
    """

    column: str
    partitions: int
    expression: str = "hashtext(CAST({column} AS text))"


Partitioning = JdbcPartitioning | JdbcRanges | JdbcHashes
BOUNDS_ALIAS = "column_bounds"


def entity_query(entity: Entity, table: str | None = None) -> str:
    """A subquery that renames a table's snake_case columns to the entity's.

    The names are quoted because databases fold the case of bare identifiers.
    """
    columns = ", ".join(f'{_snake_case(n)} AS "{n}"' for n in entity.raw.names)
    return f"(SELECT {columns} FROM {table or entity.name}) AS {entity.name}_rows"


def _snake_case(name: str) -> str:
    return re.sub(r"(?<!^)([A-Z])", r"_\1", name).lower()


def jdbc_options(
    connection: JdbcConnection, dbtable: str, partitioning: JdbcPartitioning | None = None
) -> dict[str, str]:
    """Reader options for a table name or a parenthesised, aliased subquery."""
    options = {"url": connection.url, **_login(connection), "dbtable": dbtable}
    if partitioning is not None:
        options |= {
            "partitionColumn": partitioning.column,
            "lowerBound": partitioning.lower,
            "upperBound": partitioning.upper,
            "numPartitions": str(partitioning.partitions),
        }
    return options


def read_jdbc(
    spark: SparkSession,
    connection: JdbcConnection,
    dbtable: str,
    partitioning: Partitioning | None = None,
) -> DataFrame:
    """A table or subquery; Spark sends column lists and filters to the database.

    Without ``partitioning`` one task reads everything through one connection, which
    suits dimensions; give one for anything larger. Ranges whose bounds are asked for cost one
    small query ahead of the scan.
    """
    if isinstance(partitioning, JdbcHashes):
        return spark.read.jdbc(
            connection.url,
            dbtable,
            predicates=hash_predicates(partitioning),
            properties=_login(connection),
        )
    if isinstance(partitioning, JdbcRanges):
        bounds = jdbc_options(connection, bounds_query(dbtable, partitioning.column))
        row = spark.read.format("jdbc").options(**bounds).load().first()
        partitioning = bounded(partitioning, row[0], row[1])
    options = jdbc_options(connection, dbtable, partitioning)
    return spark.read.format("jdbc").options(**options).load()


def bounds_query(dbtable: str, column: str) -> str:
    """A subquery for the least and the greatest value of a column, which an index answers.

    The column is quoted, as it is in ``entity_query`` and as Spark quotes it in its ranges.
    """
    name = _quoted(column)
    return f"(SELECT MIN({name}) AS low, MAX({name}) AS high FROM {dbtable}) AS {BOUNDS_ALIAS}"


def bounded(ranges: JdbcRanges, low: object, high: object) -> JdbcPartitioning | None:
    """Ranges between the values that the database found; None, one task, if it found none.

    Spark takes the upper bound as exclusive in sizing the ranges only. A single value cannot be
    cut, so it is read by one task as well. Fractions are rounded outwards.
    """
    if low is None or high is None or low == high:
        return None
    if isinstance(low, datetime):
        lower, upper = str(low), str(high)
    elif isinstance(low, date):
        lower, upper = low.isoformat(), high.isoformat()
    elif isinstance(low, (int, float, Decimal)):
        lower, upper = str(math.floor(low)), str(math.ceil(high))
    else:
        raise TypeError(f"{ranges.column} has no ranges to cut; read it by JdbcHashes")
    return JdbcPartitioning(ranges.column, lower, upper, ranges.partitions)


def hash_predicates(hashes: JdbcHashes) -> list[str]:
    """One condition per task: every row, null keys too, fulfils exactly one of them.

    A remainder of a negative hash is negative, so it is lifted before it is compared.
    """
    n = hashes.partitions
    if n < 1:
        raise ValueError("a scan needs a partition")
    hashed = hashes.expression.format(column=_quoted(hashes.column))
    slot = f"MOD(MOD({hashed}, {n}) + {n}, {n})"
    first = f"({slot} = 0 OR {_quoted(hashes.column)} IS NULL)"
    return [first, *[f"{slot} = {i}" for i in range(1, n)]]


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _login(connection: JdbcConnection) -> dict[str, str]:
    return {
        "user": connection.user, "password": connection.password, "driver": connection.driver
    }
