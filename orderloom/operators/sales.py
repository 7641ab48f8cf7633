"""The enriched order line and the sales totals built on it.

No join forces a broadcast. A dimension below the broadcast threshold is broadcast by
Spark, going by its file size or by what its shuffle turned out to weigh; a larger one
is sort-merged, and hot keys are split at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.columns import exact_sum, exact_total, period_start

# The columns of the fact, by name and in order.
FACT_COLUMNS = (
    "orderDetailId", "orderId", "productId", "regionId", "quantity", "unitPrice",
    "lineRevenue", "productName", "category", "catalogUnitPrice", "regionName",
    "orderTs", "orderDate", "customerId", "status",
)

PERIOD_NAMES = {"day": "orderDate", "week": "weekStart", "month": "monthStart"}

# Fixed value: a product's list price plus ten percent.
MARKUP = 1.1

# Decimals of the amounts that are added; finer than any currency, so that rounding a
# product of doubles only takes off its binary tail.
MONEY_SCALE = 6


def with_line_revenue(details: DataFrame) -> DataFrame:
    """Adds ``lineRevenue``: quantity times the price on the line, not in the catalog."""
    return details.withColumn("lineRevenue", F.col("quantity") * F.col("unitPrice"))


def join_lines_orders(details: DataFrame, orders: DataFrame) -> DataFrame:
    """Order lines with their order; ``orderId`` appears once.

    Both tables grow with the business, so neither is broadcast, not even when a well
    compressed file makes it look small. The sort-merge join leaves the lines
    partitioned by order, which a distinct count of orders can use.
    """
    return details.join(orders.hint("merge"), "orderId")


def join_product(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Lines with their product, whose list price becomes ``catalogUnitPrice``."""
    return lines.join(products.withColumnRenamed("unitPrice", "catalogUnitPrice"), "productId")


def join_region(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows with the name of their region."""
    return rows.join(regions, "regionId")


def order_lines_fact(
    details: DataFrame, orders: DataFrame, products: DataFrame, regions: DataFrame
) -> DataFrame:
    """One row per order line with product, region, order and revenue, any status."""
    lines = join_lines_orders(with_line_revenue(details), orders)
    enriched = join_region(join_product(lines, products), regions)
    return enriched.withColumn("orderDate", F.to_date("orderTs")).select(*FACT_COLUMNS)


def sale_lines(details: DataFrame, orders: DataFrame) -> DataFrame:
    """Just what the sales totals read: ids, day, quantity and revenue of each line."""
    lines = join_lines_orders(with_line_revenue(details), orders)
    return lines.select(
        "orderId", "productId", "regionId", "quantity", "lineRevenue",
        F.to_date("orderTs").alias("orderDate"),
    )


def sales_by_period(
    lines: DataFrame,
    products: DataFrame,
    regions: DataFrame,
    grain: str = "day",
    money_scale: int | None = MONEY_SCALE,
) -> DataFrame:
    """Revenue, quantity and number of orders per period, region and product.

    ``lines`` is the fact or ``sale_lines``; products and regions hold one row per
    id. Totals are formed on the ids alone and names are joined to the totals, so no
    name is shuffled with the lines. Coarser grains start from the lines again, since
    distinct orders do not add up over days or products; for several grains at once, see
    ``rollup``.

    The distinct count first combines per period, region, product and order, which
    spreads a hot group over its orders. Where the lines come from a sort-merge join
    on ``orderId`` that step needs no shuffle of its own.
    """
    period = PERIOD_NAMES.get(grain, grain)
    totals = lines.groupBy(
        period_start(F.col("orderDate"), grain).alias(period), "regionId", "productId"
    ).agg(
        exact_sum(F.col("lineRevenue"), money_scale).alias("totalRevenue"),
        F.sum("quantity").alias("totalQuantity"),
        F.count_distinct("orderId").alias("orderCount"),
    )
    return with_names(totals, products, regions, period)


def with_names(
    totals: DataFrame, products: DataFrame, regions: DataFrame, period: str
) -> DataFrame:
    """Totals by id with the names of region and product; those without either drop out."""
    return (
        totals.join(regions.select("regionId", "regionName"), "regionId")
        .join(products.select("productId", "productName"), "productId")
        .select(
            period, "regionId", "regionName", "productId", "productName",
            "totalRevenue", "totalQuantity", "orderCount",
        )
    )


def marked_up_prices(products: DataFrame) -> DataFrame:
    """Product ids with the list price plus markup."""
    return products.select("productId", (F.col("unitPrice") * MARKUP).alias("markedUpPrice"))


def reconcile_revenue(
    fact: DataFrame,
    totals: DataFrame,
    details: DataFrame,
    scale: int = MONEY_SCALE,
    tolerance: float = 1e-6,
) -> DataFrame:
    """One row that compares the fact with its totals and with the order lines.

    The one-row sums are stacked and folded; no join is needed. ``scale`` is the one that the
    totals were added with: both sides then add the same rounded amounts, as decimals, and
    are compared as decimals. Totals are stored as doubles, so half a unit in the last place of
    each is allowed besides ``tolerance``.
    """

    def side(df: DataFrame, name: str, revenue: str | None) -> DataFrame:
        amount = F.col(revenue) if revenue else F.lit(None).cast("double")
        return df.agg(
            exact_total(amount, scale).alias("revenue"),
            F.sum(F.abs(amount)).alias("size"),
            F.count(F.lit(1)).alias("rows"),
        ).withColumn("side", F.lit(name))

    def pick(name: str, column: str) -> Column:
        return F.max(F.when(F.col("side") == name, F.col(column)))

    sides = (
        side(fact, "fact", "lineRevenue")
        .unionByName(side(totals, "totals", "totalRevenue"))
        .unionByName(side(details, "details", None))
    )
    folded = sides.agg(
        pick("fact", "rows").alias("factRows"),
        pick("details", "rows").alias("detailRows"),
        F.coalesce(pick("fact", "revenue"), F.lit(0)).alias("factRevenue"),
        F.coalesce(pick("totals", "revenue"), F.lit(0)).alias("totalRevenue"),
        (tolerance + F.coalesce(pick("totals", "size"), F.lit(0.0)) / 2**53).alias("_allowed"),
    )
    apart = F.abs(F.col("factRevenue") - F.col("totalRevenue"))
    agrees = (F.col("factRows") == F.col("detailRows")) & (apart < F.col("_allowed"))
    return folded.select(
        "factRows",
        "detailRows",
        F.col("factRevenue").cast("double").alias("factRevenue"),
        F.col("totalRevenue").cast("double").alias("totalRevenue"),
        agrees.alias("reconciled"),
    )
