"""The registered queries: every operator on the benchmark tables, whole.

The benchmark tables play the order model: region and part are region and product,
orders get their region through customer and nation, line items are order lines with
the extended price standing in for the unit price. The tables hold no nulls, blanks or
orphans, so queries about those narrow a parent table or null out a column first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.entities import ForeignKey, order_entities
from orderloom.operators import quality, rollup, sales, screen
from orderloom.operators.ordinals import surrogate_ordinals
from orderloom.plans.gold import DAILY_SALES, FACT, MONTH, refresh_daily_sales
from orderloom.plans.pipeline import PipelineRun, run_pipeline
from orderloom.plans.silver import (
    REJECT_SAMPLE_SIZE,
    SilverRun,
    check,
    cleanse,
    reject_lines,
    type_timestamps,
)
from orderloom.session import staging_path, tune
from orderloom.sources.parquet import coerce_schema, read_parquet, write_parquet
from orderloom.sources.spec import Source, read_source
from orderloom.sources.text import read_body_lines, read_text

ENTITIES = order_entities(T.LongType())
MONEY_SCALE = 2
NTZ = T.TimestampNTZType()


class Tables:
    """Benchmark tables of one folder, and the order model made of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, table)
        return table

    def tuned(self, *names: str) -> Tables:
        """Sizes the session's shuffles for the base tables a query reads."""
        tune(self.spark, *[getattr(self, n) for n in names])
        return self

    def regions(self) -> DataFrame:
        return self.region.select(
            F.col("r_regionkey").alias("regionId"), F.col("r_name").alias("regionName")
        )

    def products(self) -> DataFrame:
        return self.part.select(
            F.col("p_partkey").alias("productId"),
            F.col("p_name").alias("productName"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").alias("unitPrice"),
        )

    def model_orders(self) -> DataFrame:
        placed = self.orders.join(
            self.customer, F.col("o_custkey") == F.col("c_custkey")
        ).join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        return placed.select(
            F.col("o_orderkey").alias("orderId"),
            F.col("o_orderdate").alias("orderTs"),
            F.col("n_regionkey").alias("regionId"),
            F.col("o_custkey").alias("customerId"),
            F.col("o_orderstatus").alias("status"),
        )

    def details(self) -> DataFrame:
        # Line numbers are below 10, so the id is unique per order and line number.
        return self.lineitem.select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("orderDetailId"),
            F.col("l_orderkey").alias("orderId"),
            F.col("l_partkey").alias("productId"),
            F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_extendedprice").alias("unitPrice"),
        )

    def faulty_orders(self) -> DataFrame:
        """Orders as ingested: text timestamps, some of them junk, and some null regions."""
        junk = F.when(F.col("status") == "P", F.lit("pending")).otherwise(
            F.col("orderTs").cast("string")
        )
        nowhere = F.when(F.col("orderTs") >= "1995-01-01", F.col("regionId"))
        return (
            self.model_orders()
            .withColumn("regionId", nowhere.cast("bigint"))
            .withColumn("orderTs", junk)
            .select(*ENTITIES["order"].raw.names)
        )

    def some_products(self) -> DataFrame:
        """Products without the large ones: their lines become orphans."""
        return self.part.where("p_size <= 25").select(F.col("p_partkey").alias("productId"))

    def faulty_model(self) -> dict[str, DataFrame]:
        products = self.products().join(self.some_products(), "productId", "left_semi")
        return {
            "region": self.regions().where("regionName <> 'ASIA'"),
            "product": products,
            "order": self.faulty_orders(),
            "order_details": self.details(),
        }


def _sales(t: Tables, grain: str) -> DataFrame:
    t.tuned("lineitem", "orders", "customer")
    lines = sales.sale_lines(t.details(), t.model_orders())
    return sales.sales_by_period(lines, t.products(), t.regions(), grain, MONEY_SCALE)


def daily_sales(t: Tables) -> DataFrame:
    return _sales(t, "day")


def weekly_sales(t: Tables) -> DataFrame:
    return _sales(t, "week")


def monthly_sales(t: Tables) -> DataFrame:
    return _sales(t, "month")


def fact_order_lines(t: Tables) -> DataFrame:
    t.tuned("lineitem", "orders", "customer")
    return sales.order_lines_fact(t.details(), t.model_orders(), t.products(), t.regions())


def sales_of_all_grains(t: Tables) -> DataFrame:
    """Daily, weekly and monthly sales from daily states, for which the lines are scanned once."""
    t.tuned("lineitem", "orders", "customer")
    path = staging_path(t.spark, "states")
    lines = sales.sale_lines(t.details(), t.model_orders())
    write_parquet(rollup.daily_states(lines, MONEY_SCALE), path)
    found = []
    for daily in rollup.by_heat(t.spark.read.parquet(path)):
        for grain, period in sales.PERIOD_NAMES.items():
            # Days too, so that all grains read the same columns and share a shuffle.
            states = rollup.roll_up(daily, grain, MONEY_SCALE)
            totals = rollup.sales_of_states(states, t.products(), t.regions(), grain, MONEY_SCALE)
            found.append(totals.withColumnRenamed(period, "periodStart").withColumn("grain", F.lit(grain)))
    return reduce(DataFrame.unionByName, found)


def reconcile_revenue(t: Tables) -> DataFrame:
    t.tuned("lineitem", "orders", "customer")
    # The fact is stored, as gold does, so that the join runs once for both of its readers.
    path = staging_path(t.spark, "fact")
    made = sales.order_lines_fact(t.details(), t.model_orders(), t.products(), t.regions())
    made.select("orderId", "productId", "regionId", "quantity", "lineRevenue", "orderDate").write.parquet(path)
    fact = t.spark.read.parquet(path)
    totals = sales.sales_by_period(fact, t.products(), t.regions(), "day", MONEY_SCALE)
    return sales.reconcile_revenue(fact, totals, t.lineitem, MONEY_SCALE)


def line_revenue(t: Tables) -> DataFrame:
    return sales.with_line_revenue(t.details())


def event_date(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.to_date("ts").alias("eventDate"))


def join_lines_orders(t: Tables) -> DataFrame:
    t.tuned("lineitem", "orders", "customer")
    return sales.join_lines_orders(t.details(), t.model_orders())


def join_lines_product(t: Tables) -> DataFrame:
    t.tuned("lineitem", "part")
    return sales.join_product(t.details(), t.products())


def join_orders_region(t: Tables) -> DataFrame:
    t.tuned("orders", "customer")
    return sales.join_region(t.model_orders(), t.regions())


def drop_orphans(t: Tables) -> DataFrame:
    t.tuned("lineitem", "part")
    return quality.drop_orphans(t.details(), "productId", t.some_products(), "productId", True)


def missing_references(t: Tables) -> DataFrame:
    t.tuned("lineitem", "part")
    return quality.missing_references(t.details(), "productId", t.some_products(), "productId")


def drop_orphans_two_fk(t: Tables) -> DataFrame:
    t.tuned("lineitem", "orders", "part")
    open_orders = t.orders.where("o_orderstatus <> 'P'")
    with_order = quality.drop_orphans(t.details(), "orderId", open_orders, "o_orderkey", True)
    return quality.drop_orphans(with_order, "productId", t.some_products(), "productId", True)


def _few_orders(t: Tables) -> DataFrame:
    """Old orders still in progress, a few in a hundred: the lines of all others become orphans."""
    return t.orders.where("o_orderstatus = 'P' AND o_orderdate < TIMESTAMP_NTZ '1996-01-01'")


def drop_orphans_screened(t: Tables) -> DataFrame:
    t.tuned("lineitem", "orders")
    return screen.drop_orphans_screened(
        t.details(), "orderId", _few_orders(t), "o_orderkey", unique=True
    )


def missing_references_screened(t: Tables) -> DataFrame:
    t.tuned("lineitem", "orders")
    return screen.missing_references_screened(
        t.details(), "orderId", _few_orders(t), "o_orderkey"
    )


def dedupe_by_key(t: Tables) -> DataFrame:
    t.tuned("lineitem")
    return quality.dedupe_by_key(t.lineitem, ["l_orderkey", "l_linenumber"])


def count_duplicate_keys(t: Tables) -> DataFrame:
    t.tuned("lineitem")
    return quality.count_duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"])


def count_null_keys(t: Tables) -> DataFrame:
    segment = F.col("c_mktsegment")
    # Three kinds of blank, and a no-break space, which is none.
    key = (
        F.when(segment == "BUILDING", F.lit(None))
        .when(segment == "MACHINERY", F.lit(""))
        .when(segment == "FURNITURE", F.lit("\t \n"))
        .when(segment == "HOUSEHOLD", F.lit("\u00a0"))
        .otherwise(segment)
    )
    return quality.count_null_keys(t.customer, key)


def non_empty_gate(t: Tables) -> DataFrame:
    return quality.non_empty_report(
        {
            "region": t.region,
            "product": t.part,
            "order": t.orders,
            "order_details": t.lineitem,
            "large_product": t.part.where("p_size > 1000"),
        }
    )


def _rejected(t: Tables) -> DataFrame:
    """Lines without a product, each table read once: the rows of a check that lack a flag."""
    t.tuned("lineitem", "part")
    lines = replace(
        ENTITIES["order_details"],
        foreign_keys=(ForeignKey("productId", "product", "productId"),),
    )
    checked = check(lines, t.details(), {"product": t.some_products()}, unique_parents=True)
    return checked.rejected().drop("missingParent")


def rejected_rows(t: Tables) -> DataFrame:
    return _rejected(t)


def reject_sample(t: Tables) -> DataFrame:
    return quality.first_rows(_rejected(t), ["orderDetailId"], REJECT_SAMPLE_SIZE)


def reject_sample_text(t: Tables) -> DataFrame:
    return reject_lines(reject_sample(t))


def rows_not_in(t: Tables) -> DataFrame:
    """Whole-row difference with copies and nulls on the left."""
    t.tuned("lineitem")

    def flags(lines: DataFrame) -> DataFrame:
        return lines.select(
            F.nullif("l_returnflag", F.lit("A")).alias("returnFlag"),
            F.col("l_linestatus").alias("lineStatus"),
            F.col("l_linenumber").alias("lineNumber"),
        )

    return quality.rows_not_in(flags(t.lineitem), flags(t.lineitem.where("l_linenumber > 2")))


def distinct_keys(t: Tables) -> DataFrame:
    t.tuned("lineitem")
    return quality.distinct_keys(t.details(), ["productId"])


def ordinals(t: Tables) -> DataFrame:
    t.tuned("orders")
    return surrogate_ordinals(t.orders, "o_custkey")


def order_region_map(t: Tables) -> DataFrame:
    t.tuned("orders", "customer")
    unique = quality.dedupe_by_key(t.model_orders(), ["orderId"])
    return unique.select("orderId", "regionId")


def order_region_map_size(t: Tables) -> DataFrame:
    t.tuned("orders", "customer")
    return t.model_orders().agg(F.count_distinct("orderId").alias("mappings"))


def marked_up_prices(t: Tables) -> DataFrame:
    return sales.marked_up_prices(t.products())


def marked_up_prices_sample(t: Tables) -> DataFrame:
    return quality.first_rows(marked_up_prices(t), ["productId"], 3)


def _foreign_products(t: Tables) -> DataFrame:
    """Products as a database might hand them over: other types, case and order, some nulls,
    prices that are no number and ids too large for their type."""
    price = F.col("p_retailprice").cast("decimal(12,2)").cast("string")
    return t.part.select(
        F.when(F.col("p_type") == "PROMO", F.lit(None))
        .when(F.col("p_size") == 7, F.lit("n/a"))
        .otherwise(price)
        .alias("UNITPRICE"),
        F.col("p_type").alias("category"),
        F.nullif("p_name", F.lit("small ring")).alias("ProductName"),
        F.when(F.col("p_size") == 9, F.lit("99999999999999999999"))
        .when(F.col("p_size") <= 40, F.col("p_partkey").cast("string"))
        .cast("decimal(20,0)")
        .alias("productid"),
    )


def coerced_products(t: Tables) -> DataFrame:
    return coerce_schema(_foreign_products(t), ENTITIES["product"].raw, permissive=True)


def drop_null_required(t: Tables) -> DataFrame:
    return quality.drop_null_required(coerced_products(t), ENTITIES["product"].required)


def null_required_count(t: Tables) -> DataFrame:
    return quality.count_null_required(coerced_products(t), ENTITIES["product"].required)


def type_order_ts(t: Tables) -> DataFrame:
    t.tuned("orders", "customer")
    return type_timestamps(t.faulty_orders().select("orderId", "orderTs"), ("orderTs",), NTZ)


def type_order_ts_zoned(t: Tables) -> DataFrame:
    """As the job types them, in the session's time zone; shown as text."""
    t.tuned("orders", "customer")
    typed = type_timestamps(t.faulty_orders().select("orderId", "orderTs"), ("orderTs",))
    return typed.withColumn("orderTs", F.date_format("orderTs", "yyyy-MM-dd HH:mm:ss"))


def event_date_zoned(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.to_date(F.col("ts").cast("timestamp")).alias("eventDate"))


def typed_scan(t: Tables) -> DataFrame:
    """Lines through the scan that every layer uses: declared types, only declared columns."""
    schema = (
        T.StructType()
        .add("l_orderkey", T.LongType())
        .add("l_linenumber", T.LongType())
        .add("l_quantity", T.DoubleType())
    )
    return read_parquet(t.spark, f"{t.folder}/lineitem.parquet", schema)


def _as_text(t: Tables, rows: DataFrame, name: str, plain_file: bool = False) -> str:
    """Writes ``rows`` as comma-separated text and returns the folder.

    The first file, by name, has the header; so has every other task's file, except that
    ``plain_file`` adds a larger one without. Nulls are empty fields.
    """
    path = staging_path(t.spark, name)
    header = ",".join(rows.columns)
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]
    line = cells[0]
    for cell in cells[1:]:
        line = F.concat(line, F.lit(","), cell)
    lines = rows.select(line.alias("value"))
    heads = t.spark.range(3).select(F.lit(header).alias("value"))
    # Sub-folders fix the order of the files: a is read first.
    heads.coalesce(1).write.text(f"{path}/a")
    if plain_file:
        few = F.pmod(F.xxhash64("value"), F.lit(10)) == 0
        heads.coalesce(1).union(lines.where(few)).write.text(f"{path}/b")
        lines.where(~few).write.text(f"{path}/c")
    else:
        heads.coalesce(1).union(lines).write.text(f"{path}/b")
    return f"{path}/*"


def ingest_text_lines(t: Tables) -> DataFrame:
    """Lines over several files, repeated headers, and a larger file without one."""
    return read_body_lines(t.spark, _as_text(t, t.details(), "order_details", plain_file=True))


def _ingest(t: Tables, rows: DataFrame, name: str) -> DataFrame:
    return read_text(t.spark, _as_text(t, rows, name), ENTITIES[name].raw)


def ingest_region(t: Tables) -> DataFrame:
    return _ingest(t, t.regions(), "region")


def ingest_product(t: Tables) -> DataFrame:
    """Through the choice of source that the job makes."""
    path = _as_text(t, t.products(), "product")
    return read_source(t.spark, Source("file", path=path), ENTITIES["product"].raw)


def ingest_orders(t: Tables) -> DataFrame:
    t.tuned("orders", "customer")
    return _ingest(t, t.model_orders(), "order")


def ingest_order_details(t: Tables) -> DataFrame:
    return _ingest(t, t.details(), "order_details")


def ingest_quantity_total(t: Tables) -> DataFrame:
    """One column of re-ingested lines; the others are checked all the same."""
    lines = _ingest(t, t.details(), "order_details")
    return lines.agg(F.sum("quantity").alias("totalQuantity"), F.count(F.lit(1)).alias("rows"))


def write_readback(t: Tables) -> DataFrame:
    path = staging_path(t.spark, "orders")
    write_parquet(t.orders, path)
    return t.spark.read.parquet(path)


def write_count(t: Tables) -> DataFrame:
    """The row count the sink reports next to the rows it wrote."""
    path = staging_path(t.spark, "lineitem")
    reported = write_parquet(t.lineitem, path)
    return t.spark.read.parquet(path).agg(
        F.lit(reported).cast("bigint").alias("reportedRows"),
        F.count(F.lit(1)).alias("writtenRows"),
    )


def refreshed_sales(t: Tables) -> DataFrame:
    """Daily sales without one region, then refreshed with it from April 1998 on: earlier months stay."""
    t.tuned("lineitem", "orders")
    dims, path = (t.products(), t.regions()), staging_path(t.spark, "sales_by_month")
    lines = sales.sale_lines(t.details(), t.model_orders())
    asia = t.regions().where("regionName = 'ASIA'")
    refresh_daily_sales(lines.join(asia, "regionId", "left_anti"), *dims, path, None, MONEY_SCALE)
    refresh_daily_sales(lines, *dims, path, date(1998, 4, 15), MONEY_SCALE)
    return t.spark.read.parquet(path).drop(MONTH)


def _silver(t: Tables) -> tuple[SilverRun, str]:
    t.tuned("lineitem", "orders", "customer")
    out = staging_path(t.spark, "silver")
    return cleanse(t.spark, ENTITIES, t.faulty_model(), out, NTZ), out


def silver_orders(t: Tables) -> DataFrame:
    _, out = _silver(t)
    return t.spark.read.parquet(f"{out}/order")


def silver_order_details(t: Tables) -> DataFrame:
    _, out = _silver(t)
    return t.spark.read.parquet(f"{out}/order_details")


def silver_rejects(t: Tables) -> DataFrame:
    run, _ = _silver(t)
    return run.rejects["order_details"]


def cleansing_report(t: Tables) -> DataFrame:
    run, _ = _silver(t)
    return run.report


def _pipeline(t: Tables) -> tuple[PipelineRun, str]:
    """The job on the benchmark tables, written as text first: faulty orders, missing parents."""
    t.tuned("lineitem", "orders", "customer")
    model = t.faulty_model()
    # Text has no nulls: an order without a region names one that does not exist.
    model["order"] = model["order"].withColumn("regionId", F.coalesce("regionId", F.lit(-1)))
    sources = {n: Source("file", path=_as_text(t, rows, n)) for n, rows in model.items()}
    out = staging_path(t.spark, "job")
    layers = {n: f"{out}/{n}" for n in ("bronze", "silver", "gold")}
    run = run_pipeline(
        t.spark, sources, **layers, entities=ENTITIES, money_scale=MONEY_SCALE, timestamp_type=NTZ
    )
    return run, out


def pipeline_fact(t: Tables) -> DataFrame:
    _, out = _pipeline(t)
    return t.spark.read.parquet(f"{out}/gold/{FACT}")


def pipeline_daily_sales(t: Tables) -> DataFrame:
    _, out = _pipeline(t)
    return t.spark.read.parquet(f"{out}/gold/{DAILY_SALES}")


def pipeline_rejects(t: Tables) -> DataFrame:
    run, _ = _pipeline(t)
    return run.cleansed.rejects["order_details"]


def pipeline_report(t: Tables) -> DataFrame:
    run, _ = _pipeline(t)
    return run.cleansed.report


def pipeline_reconcile(t: Tables) -> DataFrame:
    _, out = _pipeline(t)
    fact, totals, details = (
        t.spark.read.parquet(f"{out}/{n}")
        for n in (f"gold/{FACT}", f"gold/{DAILY_SALES}", "silver/order_details")
    )
    return sales.reconcile_revenue(fact, totals, details, MONEY_SCALE)


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    "daily_sales": daily_sales,
    "weekly_sales": weekly_sales,
    "monthly_sales": monthly_sales,
    "sales_of_all_grains": sales_of_all_grains,
    "fact_order_lines": fact_order_lines,
    "reconcile_revenue": reconcile_revenue,
    "line_revenue": line_revenue,
    "event_date": event_date,
    "event_date_zoned": event_date_zoned,
    "join_lines_orders": join_lines_orders,
    "join_lines_product": join_lines_product,
    "join_orders_region": join_orders_region,
    "drop_orphans": drop_orphans,
    "missing_references": missing_references,
    "drop_orphans_two_fk": drop_orphans_two_fk,
    "drop_orphans_screened": drop_orphans_screened,
    "missing_references_screened": missing_references_screened,
    "dedupe_by_key": dedupe_by_key,
    "count_duplicate_keys": count_duplicate_keys,
    "count_null_keys": count_null_keys,
    "non_empty_gate": non_empty_gate,
    "rejected_rows": rejected_rows,
    "reject_sample": reject_sample,
    "reject_sample_text": reject_sample_text,
    "rows_not_in": rows_not_in,
    "distinct_keys": distinct_keys,
    "surrogate_ordinals": ordinals,
    "order_region_map": order_region_map,
    "order_region_map_size": order_region_map_size,
    "marked_up_prices": marked_up_prices,
    "marked_up_prices_sample": marked_up_prices_sample,
    "coerce_schema": coerced_products,
    "drop_null_required": drop_null_required,
    "null_required_count": null_required_count,
    "type_order_ts": type_order_ts,
    "type_order_ts_zoned": type_order_ts_zoned,
    "ingest_text_lines": ingest_text_lines,
    "ingest_region": ingest_region,
    "ingest_product": ingest_product,
    "ingest_orders": ingest_orders,
    "ingest_order_details": ingest_order_details,
    "ingest_quantity_total": ingest_quantity_total,
    "typed_scan": typed_scan,
    "write_readback": write_readback,
    "write_count": write_count,
    "refreshed_sales": refreshed_sales,
    "silver_orders": silver_orders,
    "silver_order_details": silver_order_details,
    "silver_rejects": silver_rejects,
    "silver_report": cleansing_report,
    "pipeline_fact": pipeline_fact,
    "pipeline_daily_sales": pipeline_daily_sales,
    "pipeline_rejects": pipeline_rejects,
    "pipeline_report": pipeline_report,
    "pipeline_reconcile": pipeline_reconcile,
}
