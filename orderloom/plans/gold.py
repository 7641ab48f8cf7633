"""Gold: the order-line fact and daily sales."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions.columns import period_start
from orderloom.operators.rollup import daily_states, roll_up, sales_of_states
from orderloom.operators.sales import MONEY_SCALE, PERIOD_NAMES, order_lines_fact, sales_by_period
from orderloom.sources.parquet import refresh_partitions, write_parquet

# The names of the gold tables.
FACT = "fact_order_lines"
DAILY_SALES = "agg_sales_by_date_region_product"

#: Daily states, from which sales of other grains are made, and where those go.
SALES_STATES = "states_sales_by_date_region_product"


#: The partition column of a daily sales table that is refreshed by months.
MONTH = PERIOD_NAMES["month"]

COARSER_SALES = {
    "week": "agg_sales_by_week_region_product",
    "month": "agg_sales_by_month_region_product",
}


def run_gold(
    spark: SparkSession,
    silver: str,
    out: str,
    money_scale: int | None = MONEY_SCALE,
    grains: Sequence[str] = (),
) -> dict[str, int]:
    """Writes the fact and the daily sales, and those by the ``grains`` week and month if asked for;
    returns row counts.

    The totals read the fact back from Parquet, six columns of fifteen, instead of
    caching it: a cached fact would not fit a large cluster's memory, and losing part
    of it would run the joins again. With coarser grains it is read once as well: for daily
    states, from which the totals of all grains are made.
    """
    tables = {
        n: spark.read.parquet(f"{silver}/{n}")
        for n in ("region", "product", "order", "order_details")
    }
    dims = tables["product"], tables["region"]
    fact = order_lines_fact(tables["order_details"], tables["order"], *dims)
    rows = {FACT: write_parquet(fact, f"{out}/{FACT}")}

    written = spark.read.parquet(f"{out}/{FACT}")
    if grains:
        # States add exactly in any case.
        scale = MONEY_SCALE if money_scale is None else money_scale
        write_parquet(daily_states(written, scale), f"{out}/{SALES_STATES}")
        states = spark.read.parquet(f"{out}/{SALES_STATES}")
        daily = sales_of_states(states, *dims, "day", scale)
    else:
        daily = sales_by_period(written, *dims, "day", money_scale)
    rows[DAILY_SALES] = write_parquet(daily, f"{out}/{DAILY_SALES}")
    for grain in grains:
        coarser = sales_of_states(roll_up(states, grain, scale), *dims, grain, scale)
        rows[COARSER_SALES[grain]] = write_parquet(coarser, f"{out}/{COARSER_SALES[grain]}")
    return rows


def refresh_daily_sales(
    lines: DataFrame,
    products: DataFrame,
    regions: DataFrame,
    path: str,
    since: date | None = None,
    money_scale: int | None = MONEY_SCALE,
) -> int:
    """Brings the daily sales at ``path`` up to date from the month of ``since`` on, all of them without
    it; returns the number of rows written.

    ``lines`` is the fact or ``sale_lines``; only lines of the months in question are read, where its
    scan can tell. The table has the rows of ``sales_by_period`` and is partitioned by month: months
    with lines are replaced whole, earlier ones stay as they are, and so does a month that has no
    lines any more. Lines without a day are a partition of their own, which every refresh replaces.
    """
    if since is not None:
        day = F.col("orderDate")
        lines = lines.where((day >= F.lit(since.replace(day=1))) | day.isNull())
    daily = sales_by_period(lines, products, regions, "day", money_scale)
    by_month = daily.withColumn(MONTH, period_start(F.col("orderDate"), "month"))
    return refresh_partitions(by_month, path, [MONTH])
