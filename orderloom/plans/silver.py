"""Silver: one row per key, no orphans, typed timestamps.

References are checked in the order in which an entity lists them, and parents are
the already cleansed tables, so a line of an order that was dropped is dropped too.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.entities import Entity
from orderloom.operators.quality import (
    dedupe_by_key,
    first_rows,
    parent_keys,
    require_non_empty,
)
from orderloom.sources.parquet import observe, read_parquet, read_rest, write_parquet, write_split

REPORT_SCHEMA = (
    "entity string, inputRows bigint, dedupedRows bigint, orphanRows bigint, keptRows bigint"
)
REJECT_SAMPLE_SIZE = 20

#: Where rejected rows go, and the column that names the parent they lack; ``KEPT`` for those without.
REJECTS, MISSING, KEPT = "_rejects", "missingParent", "-"


def type_timestamps(
    df: DataFrame, columns: tuple[str, ...], timestamp_type: T.DataType | None = None
) -> DataFrame:
    """Text as timestamps; text that is none becomes null and the row stays."""
    for name in columns:
        df = df.withColumn(name, F.col(name).try_cast(timestamp_type or T.TimestampType()))
    return df


@dataclass(frozen=True)
class Checked:
    """Deduplicated rows of an entity with one flag per reference: true, or null if absent.

    Flags come from outer joins with the parent keys, not from semi joins, so kept
    rows, rejected rows and all counts can be read off the same rows.
    """

    entity: Entity
    rows: DataFrame

    @staticmethod
    def flag(position: int) -> str:
        return f"_found_{position}"

    def _flags(self) -> list[Column]:
        return [F.col(self.flag(i)) for i in range(len(self.entity.foreign_keys))]

    def is_kept(self) -> Column:
        kept = F.lit(True)
        for found in self._flags():
            kept = kept & found.isNotNull()
        return kept

    def kept(self, timestamp_type: T.DataType | None = None) -> DataFrame:
        clean = self.rows.where(self.is_kept()).select(*self.entity.raw.names)
        return type_timestamps(clean, self.entity.timestamps, timestamp_type)

    def lacking(self) -> Column:
        """The first parent that a row lacks, null if it has all."""
        return F.coalesce(
            *[
                F.when(found.isNull(), F.lit(fk.parent))
                for found, fk in zip(self._flags(), self.entity.foreign_keys)
            ],
            F.lit(None).cast("string"),
        )

    def rejected(self) -> DataFrame:
        """Orphans, with the first parent they lack."""
        return self.rows.where(~self.is_kept()).select(
            *self.entity.raw.names, self.lacking().alias(MISSING)
        )


def check(
    entity: Entity, rows: DataFrame, parents: Mapping[str, DataFrame], unique_parents: bool = False
) -> Checked:
    """Deduplicates ``rows`` and looks up every reference.

    ``unique_parents`` says that the parents hold one row per key, as tables written
    by this layer do; see ``parent_keys``.
    """
    checked = dedupe_by_key(rows, entity.primary_key)
    for i, fk in enumerate(entity.foreign_keys):
        keys = parent_keys(parents[fk.parent], fk.parent_column, fk.column, unique_parents)
        checked = checked.join(keys.withColumn(Checked.flag(i), F.lit(True)), fk.column, "left")
    return Checked(entity, checked)


def reject_lines(rejects: DataFrame) -> DataFrame:
    """Rejected order lines as text, one column ``reject``, in a fixed format."""
    return rejects.select(
        F.format_string(
            "orderDetailId=%d order=%d product=%d", "orderDetailId", "orderId", "productId"
        ).alias("reject")
    )


@dataclass(frozen=True)
class SilverRun:
    """``report`` has one row per entity; ``rejects`` are frames, per entity with references."""

    report: DataFrame
    rejects: dict[str, DataFrame]

    def sample(self, name: str, key: tuple[str, ...]) -> DataFrame:
        return first_rows(self.rejects[name], key, REJECT_SAMPLE_SIZE)


def cleanse(
    spark: SparkSession,
    entities: Mapping[str, Entity],
    tables: Mapping[str, DataFrame],
    out: str,
    timestamp_type: T.DataType | None = None,
) -> SilverRun:
    """Cleanses ``tables`` into ``out/<entity>``; fails if one of them is empty.

    One job per entity deduplicates, checks, counts and writes. A child reads its
    parents back from ``out``: their lineage ends there, and a lost executor cannot
    set off a second run of the parent's plan. Rejects, with the first parent that they lack, are
    written by the same job, into ``out/_rejects/<entity>``. Those of an entity with timestamps keep
    the text that they came with, which its table has no column for; they come from the same
    check when somebody asks for them.
    """
    require_non_empty(tables)
    report, parents, rejects = [], {}, {}
    for name, entity in entities.items():
        result = check(entity, tables[name], parents, unique_parents=True)
        path = f"{out}/{name}"
        if entity.foreign_keys and not entity.timestamps:
            split = result.rows.select(
                *entity.raw.names, F.coalesce(result.lacking(), F.lit(KEPT)).alias(MISSING)
            )
            counts = write_split(split, MISSING, KEPT, path, f"{out}/{REJECTS}/{name}")
            deduped, kept = counts["rows"], counts["kept"]
            rejects[name] = read_rest(spark, f"{out}/{REJECTS}/{name}", split.schema)
        else:
            rows, seen = observe(result.rows, {"deduped": F.count(F.lit(1))})
            kept = write_parquet(Checked(entity, rows).kept(timestamp_type), path)
            deduped = seen.get["deduped"]
            if entity.foreign_keys:
                rejects[name] = result.rejected()
        # count() on Parquet reads file footers only.
        report.append((name, tables[name].count(), deduped, deduped - kept, kept))
        parents[name] = spark.read.parquet(path)
    return SilverRun(spark.createDataFrame(report, REPORT_SCHEMA), rejects)


def run_silver(
    spark: SparkSession,
    entities: Mapping[str, Entity],
    bronze: str,
    out: str,
    timestamp_type: T.DataType | None = None,
) -> SilverRun:
    """Cleanses ``bronze/<entity>`` into ``out/<entity>``, see ``cleanse``."""
    raw = {n: read_parquet(spark, f"{bronze}/{n}", e.raw) for n, e in entities.items()}
    return cleanse(spark, entities, raw, out, timestamp_type)
