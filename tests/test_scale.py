"""Plans under skew, settings, and what must not occur in any plan."""

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from __spark_entry__ import entry, oracle_sql, queries
from orderloom import session
from orderloom.oracles import ORACLES
from orderloom.queries import QUERIES
from orderloom.entities import Entity, ForeignKey
from orderloom.operators import quality, sales
from orderloom.plans.silver import check
from orderloom.sources.parquet import observe, write_parquet
from tests.conftest import final_plan

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()

LINES, ORDERS = 300_000, 5_000


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """A third of the lines in one order, and a third of them without an order at all."""
    folder = str(tmp_path_factory.mktemp("skewed"))
    third = F.col("id") % 3
    spark.range(LINES).select(
        F.col("id").alias("orderDetailId"),
        F.when(third == 0, 7).when(third == 1, F.pmod(F.xxhash64("id"), F.lit(ORDERS))).alias("orderId"),
        (F.col("id") % 97).alias("productId"),
        (F.col("id") % 5).cast("int").alias("quantity"),
        (F.pmod(F.xxhash64("id"), F.lit(900)) / 100).alias("unitPrice"),
    ).repartition(16).write.parquet(f"{folder}/details")
    spark.range(ORDERS).select(
        F.col("id").alias("orderId"),
        F.timestamp_seconds(F.col("id") * 3600).alias("orderTs"),
        (F.col("id") % 4).alias("regionId"),
        F.col("id").alias("customerId"),
        F.lit("NEW").alias("status"),
    ).write.parquet(f"{folder}/orders")
    return spark.read.parquet(f"{folder}/details"), spark.read.parquet(f"{folder}/orders")


@pytest.fixture
def small_partitions(spark, conf):
    session.tune(spark)
    conf(
        {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
        }
    )


def is_split(plan):
    return "SortMergeJoin(skew=true)" in plan


@pytest.mark.parametrize("parent", ["stored", "with copies", "deduplicated"])
def test_orphan_filter_splits_a_hot_key(skewed, small_partitions, parent):
    details, orders = skewed
    parents = {
        "stored": orders,
        "with copies": orders.union(orders),
        "deduplicated": quality.dedupe_by_key(orders, ["orderId"]),
    }[parent]
    kept = quality.drop_orphans(details, "orderId", parents, "orderId", parent == "stored")
    result = kept.agg(F.count("orderDetailId"), F.sum("unitPrice"))
    assert is_split(final_plan(result))
    assert result.first()[0] == details.where("orderId is not null").count() == LINES * 2 // 3


def test_reference_flags_split_hot_and_null_keys(skewed, small_partitions):
    details, orders = skewed
    ids = T.StructType([T.StructField(n, T.LongType()) for n in ("orderDetailId", "orderId")])
    entity = Entity("lines", ids, ("orderDetailId",), (ForeignKey("orderId", "order", "orderId"),))
    cleansed = quality.dedupe_by_key(orders, ["orderId"])
    for parent, unique in ((orders, True), (orders, False), (cleansed, False)):
        checked = check(entity, details, {"order": parent}, unique)
        counts = checked.rows.agg(F.count("unitPrice"), F.count_if(checked.is_kept()))
        assert is_split(final_plan(counts))
        assert tuple(counts.first()) == (LINES, LINES * 2 // 3)


def test_row_difference_splits_a_hot_key(skewed, small_partitions):
    details, orders = skewed
    ordered = details.where("orderId <> 7 or orderId is null")
    left = quality.rows_not_in(details, ordered, ["orderId"])
    result = left.agg(F.count("orderDetailId"), F.sum("unitPrice"))
    assert is_split(final_plan(result))
    assert result.first()[0] == details.where("orderId = 7").count() >= LINES // 3


def test_fact_join_splits_a_hot_order(skewed, small_partitions):
    details, orders = skewed
    result = sales.join_lines_orders(details, orders).agg(F.count("status"), F.sum("unitPrice"))
    assert is_split(final_plan(result))
    assert result.first()[0] == LINES * 2 // 3


def test_sales_totals_split_a_hot_order(spark, skewed, small_partitions):
    details, orders = skewed
    products = spark.range(97).selectExpr("id AS productId", "'p' AS productName")
    regions = spark.range(4).selectExpr("id AS regionId", "'r' AS regionName")
    daily = sales.sales_by_period(sales.sale_lines(details, orders), products, regions, "day", 2)
    result = daily.agg(F.sum("totalQuantity"), F.sum("orderCount"))
    assert is_split(final_plan(result))
    known = details.where("orderId is not null")
    assert result.first()[0] == known.agg(F.sum("quantity")).first()[0]
    assert result.first()[1] == known.select("orderId", "productId").distinct().count()


def test_counts_taken_while_writing_survive_a_split(spark, skewed, small_partitions, tmp_path):
    lines, seen = observe(sales.join_lines_orders(*skewed), {"all": F.count(F.lit(1))})
    written = write_parquet(lines.where("quantity > 0"), str(tmp_path / "out"))
    assert seen.get["all"] == LINES * 2 // 3
    assert written == spark.read.parquet(str(tmp_path / "out")).count() < LINES * 2 // 3


def test_missing_references_shuffles_counts_only(skewed, small_partitions):
    details, orders = skewed
    result = quality.missing_references(details, "orderId", orders, "orderId")
    plan = final_plan(result)
    # Either side is combined before it is shuffled.
    assert plan.count("Exchange hashpartitioning") == 2
    below = [part.split("\n")[1] for part in plan.split("Exchange hashpartitioning")[1:]]
    assert all("HashAggregate(keys=[orderId" in line for line in below)
    assert result.first().missing == LINES // 3


def test_partition_sizing():
    gib, tib = 1 << 30, 1 << 40
    assert session.partitions_for(0, 8) == 8
    assert session.partitions_for(100 * gib, 8) == 400
    # No ceiling: a partition of a larger job is no larger.
    assert session.partitions_for(300 * tib, 8000) == 300 * tib // session.BYTES_PER_PARTITION
    assert session.split_bytes_for(100 * gib) == 128 << 20
    assert 500e6 < session.split_bytes_for(300 * tib) < 600e6


def test_tasks_are_sized_by_shuffle_bytes(spark, conf):
    merged, blocks = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    conf({"spark.sql.shuffle.partitions": "8"})
    session.tune(spark, spark.range(1 << 30))
    assert spark.conf.get(merged) == f"{16 << 20}b"
    # A number of partitions set by hand stays, and so does a size.
    assert spark.conf.get(blocks, None) in (None, "<undefined>")
    conf({merged: "3MB"})
    spark.conf.unset("spark.sql.shuffle.partitions")
    session.tune(spark, spark.range(1 << 30))
    assert spark.conf.get(merged) == "3MB"
    assert int(spark.conf.get(blocks)) == 8 * int(spark.conf.get("spark.sql.shuffle.partitions")) == 256
    spark.conf.unset(merged)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    session.tune(spark, spark.range(1 << 30))
    assert spark.conf.get(merged) == f"{16 << 20}b" and spark.conf.get(blocks, None) in (None, "<undefined>")


def test_size_of_a_scan(spark):
    table = spark.read.parquet(f"{DATA}/lineitem.parquet")
    assert 50_000 < session.scan_bytes(table) < 50_000_000


@pytest.mark.parametrize("by_hand", ["33", "200", "1"])
def test_tune_keeps_sizes_set_by_hand(spark, conf, by_hand):
    conf({"spark.sql.shuffle.partitions": by_hand})
    session.tune(spark, spark.read.parquet(f"{DATA}/lineitem.parquet"))
    assert spark.conf.get("spark.sql.shuffle.partitions") == by_hand


def test_tune_follows_the_data_up_and_down(spark, conf, monkeypatch):
    keys = ["spark.sql.shuffle.partitions", "spark.sql.files.maxPartitionBytes"]
    conf({k: spark.conf.get(k) for k in keys})
    for key in keys:
        spark.conf.unset(key)
    sizes = iter([300 << 40, 1 << 20, 1 << 40])
    monkeypatch.setattr(session, "scan_bytes", lambda df: next(sizes))
    found = []
    for _ in range(3):
        session.tune(spark, spark.range(1))
        found.append([spark.conf.get(k) for k in keys])
    assert found == [
        ["1228800", "549755813b"], ["8", "134217728b"], ["4096", "134217728b"],
    ]


def test_shared_folder_is_the_configured_one(spark, conf):
    assert session.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.shared_dir(spark, "s3://x/") == "s3://x"
    assert session.staging_path(spark, "x") != session.staging_path(spark, "x")


def test_orphan_filter_shuffles_parent_keys_once_more_at_most(skewed, small_partitions):
    details, orders = skewed
    for unique, exchanges in ((True, 2), (False, 3)):
        kept = quality.drop_orphans(details, "orderId", orders, "orderId", unique)
        assert final_plan(kept).count("Exchange hashpartitioning") == exchanges


def test_rejects_scan_and_deduplicate_once(spark, small_partitions):
    plan = queries()["rejected_rows"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2 and plan.count("Window ") == 1


def test_a_gate_looks_at_one_partition(spark):
    table = spark.range(0, 1000, 1, 50)
    spark.sparkContext.setJobGroup("gate", "gate")
    try:
        assert quality.has_rows(table)
        tracker = spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("gate") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setJobGroup("tests", "tests")
    assert sum(s.numTasks for s in stages) == 1


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def test_every_query_has_a_twin():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= queries().keys() and ORACLES.keys() <= oracle_sql().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_against_its_twin(spark, oracle, name):
    df = queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    twin = oracle.sql(oracle_sql()[name])
    assert sorted(twin.columns) == columns
    order = [twin.columns.index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in twin.fetchall()), key=repr)
    assert found == expected
    assert found

    plan = df._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas"):
        assert unwanted not in plan


def test_entry(spark):
    assert entry(spark).columns[-3:] == ["totalRevenue", "totalQuantity", "orderCount"]
