"""Data-quality operators for any table.

Nothing here logs, collects or caches. Counts come back as one-row frames, so a
caller can join them into a larger report or bring the single row to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.functions.columns import any_null, is_blank


def count_null_keys(df: DataFrame, key: str | Column) -> DataFrame:
    """One row, ``nullKeys``: rows whose key is null, empty or white space."""
    key = F.col(key) if isinstance(key, str) else key
    return df.agg(F.count_if(is_blank(key)).alias("nullKeys"))


def count_duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row, ``duplicateKeys``: how many key values occur more than once.

    Counts values, not surplus rows; a null key is a value like any other. The
    count is combined before the shuffle, so a key that holds a large share of the
    table travels as one row per task.
    """
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return per_key.agg(F.count_if(F.col("copies") > 1).alias("duplicateKeys"))


def dedupe_by_key(
    df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column] | None = None
) -> DataFrame:
    """One row per key: the first by ``order_by``, or by all other columns.

    The default order is total up to identical rows, so a task that is run again
    after a lost executor keeps the same row; ``dropDuplicates`` promises no such
    thing. Spark plans the rank filter with a group limit ahead of the shuffle: every
    task sends at most one row per key, however many copies a key has.
    """
    order = list(order_by) if order_by is not None else [c for c in df.columns if c not in keys]
    order = order or list(keys)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The set of key values."""
    return df.select(*keys).distinct()


def parent_keys(parent: DataFrame, key: str, name: str, unique: bool = False) -> DataFrame:
    """Non-null parent keys, one row each, in a column called ``name``.

    ``unique=True`` says the parent is a stored table with one row per key. Otherwise
    copies are collapsed here, and the keys are dealt out once more, see ``dealt_out``: two
    shuffles of the bare parent keys besides that of the join.
    """
    keys = parent.select(F.col(key).alias(name)).where(F.col(name).isNotNull())
    return keys if unique else dealt_out(keys.distinct(), name)


def dealt_out(keys: DataFrame, name: str) -> DataFrame:
    """``keys`` repartitioned by a hash of their own, so that a join shuffles them itself.

    Adaptive execution splits hot partitions of the child only where a join reads both of
    its shuffles directly. Keys that are already partitioned, as they are after an
    aggregate or a deduplication, would be joined without a shuffle of their own and put those
    operators in between. The child is not moved again.
    """
    return keys.repartition(F.hash(name))


def drop_orphans(
    child: DataFrame, fk: str, parent: DataFrame, key: str, unique: bool = False
) -> DataFrame:
    """Child rows whose foreign key exists in the parent; a null key does not.

    No hint: Spark broadcasts the keys if their size allows it, before or during the
    run, and else sort-merges, splitting hot child keys over several tasks. Copies of parent
    keys do no harm here and are not collapsed; a parent that is not ``unique`` costs one more
    shuffle of its bare keys.
    """
    keys = parent.select(F.col(key).alias(fk)).where(F.col(fk).isNotNull())
    return child.join(keys if unique else dealt_out(keys, fk), fk, "left_semi")


def missing_references(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """One row, ``missing``: child rows whose foreign key is not in the parent.

    Child rows are counted per key before anything is joined, so the join sees each
    key once and no row of the child is shuffled whole. Null keys count as missing.
    """
    per_key = child.groupBy(fk).agg(F.count(F.lit(1)).alias("rows"))
    known = parent.select(F.col(key).alias(fk)).distinct()
    absent = per_key.join(known, fk, "left_anti")
    return absent.agg(F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("missing"))


def rows_not_in(
    df: DataFrame, other: DataFrame, keys: Sequence[str] | None = None, unique: bool = False
) -> DataFrame:
    """Rows of ``df`` with no equal in ``other``, by ``keys`` or by all columns.

    Every copy of a matching row goes and copies of the others stay, which neither
    EXCEPT nor EXCEPT ALL does. Nulls equal nulls. ``unique=True`` says that ``other`` has
    one row per key, which saves collapsing its copies before they are shuffled.
    """
    names = list(keys) if keys is not None else df.columns
    right = other.select(*[F.col(n).alias(f"_other_{i}") for i, n in enumerate(names)])
    right = right if unique else right.distinct()
    matches = F.lit(True)
    for i, n in enumerate(names):
        matches = matches & F.col(n).eqNullSafe(F.col(f"_other_{i}"))
    return df.join(right, matches, "left_anti")


def first_rows(df: DataFrame, order_by: Sequence[str], n: int) -> DataFrame:
    """A reproducible sample: the ``n`` first rows by a total order."""
    return df.orderBy(*order_by).limit(n)


def lacks_required(df: DataFrame, required: Sequence[str]) -> Column:
    """True where a required column is null or, as ``na.drop`` sees it, not a number."""
    lacking = any_null(*required)
    for name in required:
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            lacking = lacking | F.isnan(name)
    return lacking


def drop_null_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows with a value in every required column."""
    return df.where(~lacks_required(df, required))


def count_null_required(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """One row, ``inputRows`` and ``droppedRows``, as ``drop_null_required`` would leave out."""
    return df.agg(
        F.count(F.lit(1)).alias("inputRows"),
        F.count_if(lacks_required(df, required)).alias("droppedRows"),
    )


def non_empty_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: ``entity`` and whether it has at least one row."""
    first = next(iter(tables.values()))
    found = [(name, has_rows(df)) for name, df in tables.items()]
    return first.sparkSession.createDataFrame(found, "entity string, nonEmpty boolean")


def has_rows(df: DataFrame) -> bool:
    """Looks at one partition, and at more only if it is empty."""
    return bool(df.take(1))


def require_non_empty(tables: Mapping[str, DataFrame]) -> None:
    """Raise ValueError that names the empty tables, if there are any."""
    empty = [name for name, df in tables.items() if not has_rows(df)]
    if empty:
        raise ValueError(f"no rows in: {', '.join(empty)}")
