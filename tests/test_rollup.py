"""Daily states and what is rolled up from them, against totals from the lines."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from orderloom.operators import sales
from orderloom.operators.rollup import BUCKET_BITS, by_heat, daily_states, roll_up, sales_of_states
from orderloom.queries import MONEY_SCALE
from orderloom.plans.gold import COARSER_SALES, DAILY_SALES, FACT, SALES_STATES, run_gold
from tests.conftest import final_plan, rows

SCHEMA = "orderId bigint, productId int, regionId int, quantity int, lineRevenue double, orderDate date"


@pytest.fixture
def dims(spark):
    products = spark.createDataFrame(
        [(i, f"P{i}", "c", 1.0) for i in range(5)],
        "productId int, productName string, category string, unitPrice double",
    )
    return products, spark.createDataFrame([(1, "N"), (2, "S")], "regionId int, regionName string")


def lines_of(spark, n=3_000, seed=1):
    """Lines of orders over several days, with ids at both ends of the range, null ids and days."""
    rng = random.Random(seed)
    ids = [0, -1, 1, 2**63 - 1, -(2**63), 2**15, 2**15 - 1, None, *(rng.randrange(-10**6, 10**6) for _ in range(300))]
    first = dt.date(2023, 12, 20)
    data = [
        (
            rng.choice(ids), rng.randrange(6), rng.choice([1, 2, 2, None]), rng.randrange(5),
            rng.choice([round(rng.uniform(-5, 90), 2), rng.uniform(0, 1e6), None]),
            rng.choice([None, *(first + dt.timedelta(d) for d in range(45))]),
        )
        for _ in range(n)
    ]
    return spark.createDataFrame(data, SCHEMA).repartition(5)


@pytest.mark.parametrize("grain", ["day", "week", "month"])
@pytest.mark.parametrize("scale", [0, 2, 6])
def test_states_give_the_totals_of_the_lines(spark, dims, grain, scale):
    lines = lines_of(spark)
    states = daily_states(lines, scale)
    rolled = states if grain == "day" else roll_up(states, grain, scale)
    found = rows(sales_of_states(rolled, *dims, grain, scale))
    assert found == rows(sales.sales_by_period(lines, *dims, grain, scale)) != []


def test_an_order_on_several_days_counts_once_a_week(spark, dims):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 3), dt.date(2024, 1, 7), dt.date(2024, 1, 8)]
    data = [(i, 1, 1, 1, 1.0, d) for d in days for i in (7, -7, None)]
    weekly = sales_of_states(
        roll_up(daily_states(spark.createDataFrame(data, SCHEMA)), "week"), *dims, "week"
    )
    assert sorted((r.weekStart, r.orderCount, r.totalQuantity) for r in weekly.collect()) == [
        (dt.date(2024, 1, 1), 2, 9), (dt.date(2024, 1, 8), 2, 3),
    ]


def test_states_of_several_loads_are_merged(spark, dims):
    lines = lines_of(spark).withColumn("part", F.pmod(F.xxhash64("quantity", "lineRevenue"), F.lit(3)))
    loads = [daily_states(lines.where(F.col("part") == i).drop("part")) for i in range(3)]
    merged = roll_up(loads[0].unionByName(loads[1]).unionByName(loads[2]), "day")
    assert rows(sales_of_states(merged, *dims)) == rows(sales.sales_by_period(lines, *dims))


def test_not_a_number_and_no_lines(spark, dims):
    data = [(1, 1, 1, 1, float("nan"), dt.date(2024, 1, 1)), (2, 1, 1, 1, 2.0, dt.date(2024, 1, 2))]
    states = roll_up(daily_states(spark.createDataFrame(data, SCHEMA)), "month")
    assert str(sales_of_states(states, *dims, "month").first().totalRevenue) == "nan"
    none = daily_states(spark.createDataFrame([], SCHEMA))
    assert sales_of_states(roll_up(none, "week"), *dims, "week").collect() == []


def test_a_hot_group_is_spread_over_buckets(spark):
    # All orders of a day, region and product: a hundred buckets, each a bounded row.
    size = 1 << BUCKET_BITS
    lines = spark.range(0, 10 * size, 1, 8).select(
        F.col("id").alias("orderId"), F.lit(1).alias("productId"), F.lit(1).alias("regionId"),
        F.lit(1).alias("quantity"), F.lit(0.5).alias("lineRevenue"),
        F.lit(dt.date(2024, 1, 1)).alias("orderDate"),
    )
    held = daily_states(lines).agg(F.count(F.lit(1)), F.max(F.size("orders")), F.sum(F.size("orders")))
    assert tuple(held.first()) == (10, size, 10 * size)


def test_all_grains_scan_the_lines_once(spark, tmp_path, dims):
    lines_of(spark).write.parquet(f"{tmp_path}/lines")
    states = daily_states(spark.read.parquet(f"{tmp_path}/lines"))
    plan = final_plan(states)
    assert plan.count("Scan parquet") == 1
    states.write.parquet(f"{tmp_path}/states")
    stored = spark.read.parquet(f"{tmp_path}/states")
    for grain in ("week", "month"):
        files = sales_of_states(roll_up(stored, grain), *dims, grain).inputFiles()
        assert files and all("/states/" in f for f in files)


@pytest.mark.parametrize("hot_states", [0, 150, 10**6])
def test_parts_by_heat_give_the_totals_of_the_lines(spark, dims, hot_states):
    lines = lines_of(spark)
    parts = by_heat(daily_states(lines), hot_states)
    assert [p.isEmpty() for p in parts] == [hot_states == 0, hot_states == 10**6]
    for grain in ("day", "week", "month"):
        cold, hot = (sales_of_states(roll_up(p, grain), *dims, grain) for p in parts)
        assert rows(cold.unionByName(hot)) == rows(sales.sales_by_period(lines, *dims, grain))


def test_grains_share_the_shuffle_of_the_states(spark, tmp_path, dims, conf):
    conf({"spark.sql.autoBroadcastJoinThreshold": "-1"})
    daily_states(lines_of(spark)).write.parquet(f"{tmp_path}/states")
    cold, _ = by_heat(spark.read.parquet(f"{tmp_path}/states"))
    found = [
        sales_of_states(roll_up(cold, grain), *dims, grain).withColumnRenamed(period, "period")
        for grain, period in sales.PERIOD_NAMES.items()
    ]
    plan = final_plan(found[0].unionByName(found[1]).unionByName(found[2]))
    # Once over all columns, and no totals by period are shuffled; names are joined by id.
    assert plan.count("REPARTITION_BY_COL") == 1 or "ReusedExchange" in plan
    assert not any("period" in x.split("\n")[0] for x in plan.split("Exchange hashpartitioning(")[1:])


def test_gold_writes_coarser_sales_from_states(spark, tmp_path, dims):
    products, regions = dims
    silver, out = f"{tmp_path}/silver", f"{tmp_path}/gold"
    products.write.parquet(f"{silver}/product")
    regions.write.parquet(f"{silver}/region")
    spark.range(400).select(
        "id", (F.col("id") % 40).cast("int").alias("regionId"), F.lit(1).alias("customerId"),
        F.timestamp_seconds(F.col("id") * 30_000).alias("orderTs"), F.lit("NEW").alias("status"),
    ).withColumnRenamed("id", "orderId").withColumn("regionId", F.col("regionId") % 2 + 1).write.parquet(f"{silver}/order")
    spark.range(2_000).select(
        F.col("id").alias("orderDetailId"), (F.col("id") % 400).alias("orderId"),
        (F.col("id") % 5).cast("int").alias("productId"), (F.col("id") % 9).cast("int").alias("quantity"),
        (F.col("id") % 1000 / 100).alias("unitPrice"),
    ).write.parquet(f"{silver}/order_details")
    run = run_gold(spark, silver, out, MONEY_SCALE, ("week", "month"))
    fact = spark.read.parquet(f"{out}/{FACT}")
    for grain, name in {"day": DAILY_SALES, **COARSER_SALES}.items():
        stored = spark.read.parquet(f"{out}/{name}")
        assert rows(stored) == rows(sales.sales_by_period(fact, products, regions, grain, MONEY_SCALE))
        assert run[name] == stored.count()
    assert spark.read.parquet(f"{out}/{SALES_STATES}").count() > 0
    totals, details = spark.read.parquet(f"{out}/{DAILY_SALES}"), spark.read.parquet(f"{silver}/order_details")
    assert sales.reconcile_revenue(fact, totals, details, MONEY_SCALE).first().reconciled
