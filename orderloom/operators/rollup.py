"""Sales totals that add up: daily states from one scan of the lines, rolled up to weeks and months.

Revenue and quantity add up over days, distinct orders do not: an order may have lines on several
days. So a state keeps the orders themselves, as numbers inside a bucket of 2^15 consecutive ids:
one row per day, region, product and bucket. Sets of a bucket are merged by union, and the number of
orders is the sum of the sizes of a group's buckets. A set has 2^15 members at most, so however hot a
product is, no row and no task holds all of its orders.

Sets are sorted arrays and not bitmaps of a bit per id: nearly all groups of a day have a few
orders, for which a bitmap of 4 KB per group and bucket would take hundreds of times their room.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.functions.columns import exact_parts, period_start, total_of
from orderloom.operators.sales import MONEY_SCALE, PERIOD_NAMES, with_names

#: Ids of a bucket agree in all bits but these.
BUCKET_BITS = 15
#: States of a region and product beyond which they are not brought into one task.
HOT_STATES = 1 << 20
_GROUP = ("regionId", "productId", "bucket")


def daily_states(lines: DataFrame, money_scale: int = MONEY_SCALE) -> DataFrame:
    """``period, regionId, productId, bucket``, the parts of the revenue, ``totalQuantity``, ``orders``.

    ``lines`` is the fact or ``sale_lines``. Any 64-bit order id has a bucket, negative ones too; a
    null one has none and is no order. Lines are first combined per group and order: where
    they come from a merge join on the order, that needs no shuffle, and a hot group is spread over
    its orders.
    """
    amount = F.col("lineRevenue")
    per_order = lines.groupBy(
        F.col("orderDate").alias("period"), "regionId", "productId",
        F.col("orderId").cast("bigint").alias("orderId"),
    ).agg(
        *[part.alias(name) for name, part in exact_parts(amount, money_scale).items()],
        F.sum("quantity").alias("totalQuantity"),
    )
    in_bucket = F.col("orderId").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")
    return (
        per_order.withColumn("bucket", F.shiftright("orderId", BUCKET_BITS))
        .groupBy("period", *_GROUP)
        .agg(*_merged(money_scale), F.array_sort(F.collect_list(in_bucket)).alias("orders"))
    )


def by_heat(states: DataFrame, hot_states: int = HOT_STATES) -> tuple[DataFrame, DataFrame]:
    """States in two parts that share no region and product, to be rolled up and totalled one by one.

    The first is shuffled by region and product, once: totals of any grain need no shuffle after that,
    and plans that read all of its columns share it. The second holds the pairs with more than
    ``hot_states`` states; those stay where they are, to be combined before they are shuffled. One pair
    in so many states is hot at most, so the list of them is broadcast.
    """
    pairs = states.groupBy("regionId", "productId").agg(F.count(F.lit(1)).alias("_states"))
    hot = F.broadcast(pairs.where(F.col("_states") > hot_states).select(
        F.col("regionId").alias("_region"), F.col("productId").alias("_product")
    ))
    is_hot = F.col("regionId").eqNullSafe(F.col("_region")) & F.col("productId").eqNullSafe(F.col("_product"))
    return (
        states.join(hot, is_hot, "left_anti").repartition("regionId", "productId"),
        states.join(hot, is_hot, "left_semi"),
    )


def roll_up(states: DataFrame, grain: str, money_scale: int = MONEY_SCALE) -> DataFrame:
    """States of a coarser grain from daily ones; of rows of one group, from several loads, as well."""
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_list("orders"))))
    return (
        states.withColumn("period", period_start(F.col("period"), grain))
        .groupBy("period", *_GROUP)
        .agg(*_merged(money_scale), union.alias("orders"))
    )


def sales_of_states(
    states: DataFrame,
    products: DataFrame,
    regions: DataFrame,
    grain: str = "day",
    money_scale: int = MONEY_SCALE,
) -> DataFrame:
    """The totals of ``sales_by_period``, from states of that grain."""
    parts = {name: F.sum(name) for name in _part_names(money_scale)}
    revenue = F.when(parts["others"] > 0, F.lit(float("nan"))).otherwise(
        total_of(parts, money_scale).cast("double")
    )
    period = PERIOD_NAMES.get(grain, grain)
    totals = states.groupBy(F.col("period").alias(period), "regionId", "productId").agg(
        revenue.alias("totalRevenue"),
        F.sum("totalQuantity").alias("totalQuantity"),
        F.sum(F.size("orders")).cast("bigint").alias("orderCount"),
    )
    return with_names(totals, products, regions, period)


def _part_names(money_scale: int) -> list[str]:
    return list(exact_parts(F.lit(0.0), money_scale))


def _merged(money_scale: int) -> list[Column]:
    return [F.sum(name).alias(name) for name in [*_part_names(money_scale), "totalQuantity"]]
