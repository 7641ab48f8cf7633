"""Shards that all hold the same mixture of sources, by stratified interleaving.

Rows are put into a seeded random order inside their source. Row r of a source of n rows
gets the fractional rank (r + u) / n, with u in (0, 1) fixed per source, so that the rows of
every source are spread evenly over [0, 1). Sorted by that number and cut into equal
pieces, any piece holds each source in proportion.

Neither rank is taken in one task. Inside a source rows are first dealt into cells by the
leading digits of their random number, cells are counted, and only then ranked: rank =
rows in the cells before + rank inside the cell. The number of cells follows the row count,
so a cell holds ``ROWS_PER_CELL`` rows or so however hot its source is. The sort over the
whole table works the same way on the fractional ranks, which are uniform by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.session import staging_path

#: Rows that one window sorts, on average. It sets task sizes, not results.
ROWS_PER_CELL = 20_000

# 13 hexadecimal digits: the most that a double holds exactly.
_DIGITS = 13
_SPAN = float(16**_DIGITS)


def _fraction(text: Column) -> Column:
    """A number in (0, 1) from the MD5 of ``text``; the same in any SQL engine."""
    digits = F.substring(F.md5(text), 1, _DIGITS)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / _SPAN


def _cell(fraction: Column, cells: Column) -> Column:
    """Which of ``cells`` equal parts of [0, 1) a number falls into."""
    return F.least(F.floor(fraction * cells), cells - 1).cast("bigint")


def proportional_shards(
    docs: DataFrame,
    shards: int = 8,
    strata: str = "source",
    row_id: str = "doc_id",
    text: str = "text",
    seed: str = "0",
    rows_per_cell: int = ROWS_PER_CELL,
) -> DataFrame:
    """Every row with its shard and its slot there.

    Returns ``row_id``, ``strata``, ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``,
    ``shard`` (0 to ``shards`` - 1) and ``slot`` (0, 1, ... in each shard, in the mixed order).
    Row counts of shards differ by one at most, and every prefix of a shard follows the
    mixture as closely as whole rows allow. Texts themselves are not shuffled.

    A null text has size 1 and the checksum 0 of an empty one; a null source is a source
    of its own; a null id is an id like any other. Rows that agree in id, size and checksum
    are interchangeable, so it does not matter which of them comes first. An empty table
    gives none. Other columns of ``docs`` are not read.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(row_id).alias("_id"),
        F.col(strata).alias("_stratum"),
        (F.octet_length(content) + 1).cast("bigint").alias("_size"),
        F.crc32(content).alias("_crc"),
    ).withColumn(
        "_draw",
        _fraction(
            F.concat_ws(
                "|",
                F.lit(seed),
                F.coalesce(F.col("_id").cast("string"), F.lit("null")),
                F.col("_size").cast("string"),
                F.col("_crc").cast("string"),
            )
        ),
    )
    # Cut: the text columns are read once, and ranks rest on what was stored.
    spark = docs.sparkSession
    path = staging_path(spark, "shard-rows")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)

    source = F.coalesce(F.concat(F.lit("s"), F.col("_stratum").cast("string")), F.lit("null"))
    rows = rows.withColumn("_source", source)
    strata_sizes = rows.groupBy("_source").agg(F.count(F.lit(1)).alias("_n"))
    cells = F.ceil(F.col("_n") / rows_per_cell)
    in_cells = rows.join(strata_sizes, "_source").withColumn("_cell", _cell(F.col("_draw"), cells))
    ties = ("_draw", "_id", "_size", "_crc")
    ranked = _ranked(in_cells, ["_source"], ties)
    fractional = ranked.withColumn(
        "_at", (F.col("_rank") + _fraction(F.concat(F.lit(f"{seed}|"), F.col("_source")))) / F.col("_n")
    )

    # Answered from the footers of what was stored; an empty table divides nothing.
    total = max(1, rows.count())
    spread = fractional.drop("_rank").withColumn(
        "_cell", _cell(F.col("_at"), F.lit(-(-total // rows_per_cell)))
    )
    placed = _ranked(spread, [], ("_at", "_source", *ties))
    # Shard k takes positions ceil(k * total / shards) up to the next one's first.
    first = F.expr(f"(_shard * {total}L + {shards - 1}) div {shards}")
    return (
        placed.withColumn("_shard", F.expr(f"(_rank * {shards}) div {total}L"))
        .select(
            F.col("_id").alias(row_id),
            F.col("_stratum").alias(strata),
            F.col("_size").alias("size"),
            F.col("_crc").alias("text_crc32"),
            F.col("_shard").cast("int").alias("shard"),
            (F.col("_rank") - first).cast("bigint").alias("slot"),
        )
    )


def _ranked(rows: DataFrame, group: list[str], order: tuple[str, ...]) -> DataFrame:
    """Adds ``_rank``, counted from 0 inside ``group`` by ``order``.

    ``_cell`` must rise with the first column of ``order``. Cell counts, one row per
    cell, are summed up in order; rows are only ever sorted inside their cell.
    """
    counts = rows.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_in_cell"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *group, "_cell", F.coalesce(F.sum("_in_cell").over(before), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy(*group, "_cell").orderBy(*order)) - 1
    # Dealt out by cell on purpose: rows that a join left partitioned by their source alone
    # would also do for the window, and put a whole source into one task.
    return (
        rows.repartition(*group, "_cell")
        .withColumn("_inside", inside)
        .join(starts, [*group, "_cell"])
        .withColumn("_rank", (F.col("_start") + F.col("_inside")).cast("bigint"))
        .drop("_start", "_inside", "_cell")
    )
