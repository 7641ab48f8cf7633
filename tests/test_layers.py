"""Cleansing and the whole pipeline, on small hand-made tables and text files."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.__main__ import main, parse, sources_of
from orderloom.entities import order_entities
from orderloom.operators.sales import reconcile_revenue, sales_by_period
from orderloom.plans.bronze import run_bronze
from orderloom.plans.gold import DAILY_SALES, FACT
from orderloom.plans.pipeline import require_separate_paths, run_pipeline
from orderloom.plans.silver import cleanse, reject_lines, run_silver, type_timestamps
from orderloom.sources import spec
from orderloom.sources.jdbc import JdbcConnection, JdbcPartitioning, entity_query
from orderloom.sources.spec import Source
from tests.conftest import rows

ENTITIES = order_entities()


def frame(spark, name, data):
    # Nullable throughout: foreign keys are to be null in some tests.
    fields = [T.StructField(f.name, f.dataType) for f in ENTITIES[name].raw.fields]
    return spark.createDataFrame(data, T.StructType(fields))


@pytest.fixture
def dirty(spark):
    return {
        "region": frame(spark, "region", [(1, "North"), (1, "Nord"), (2, "South")]),
        "product": frame(spark, "product", [(1, "Lamp", "Home", 9.0), (2, "Kite", None, 4.0)]),
        "order": frame(
            spark,
            "order",
            [
                (10, "2024-01-05T10:00:00", 1, 100, "NEW"),
                (10, "2024-01-06T10:00:00", 9, 100, "NEW"),
                (11, "2024-01-05T10:00:00", 9, 100, "NEW"),
                (12, "junk", 2, 101, "CANCELLED"),
                (13, "2024-01-05T10:00:00", None, 101, "NEW"),
            ],
        ),
        "order_details": frame(
            spark,
            "order_details",
            [
                (1, 10, 1, 1, 1.0),
                (1, 10, 1, 1, 1.0),
                (2, 11, 1, 1, 1.0),
                (3, 12, 2, 2, 2.5),
                (4, 12, 7, 1, 1.0),
                (5, 13, 1, 1, 1.0),
                (6, None, 1, 1, 1.0),
                (7, 99, 7, 1, 1.0),
            ],
        ),
    }


REPORT = [
    ("order", 5, 4, 2, 2),
    ("order_details", 8, 7, 5, 2),
    ("product", 2, 2, 0, 2),
    ("region", 3, 2, 0, 2),
]
KEPT_DETAILS = [(1, 10, 1, 1, 1.0), (3, 12, 2, 2, 2.5)]


def test_cleansing(spark, dirty, tmp_path):
    out = str(tmp_path)
    run = cleanse(spark, ENTITIES, dirty, out)
    assert rows(spark.read.parquet(f"{out}/region")) == [(1, "Nord"), (2, "South")]
    orders = spark.read.parquet(f"{out}/order")
    assert orders.schema["orderTs"].dataType == T.TimestampType()
    assert rows(orders) == sorted(
        [
            (10, dt.datetime(2024, 1, 5, 10), 1, 100, "NEW"),
            (12, None, 2, 101, "CANCELLED"),
        ],
        key=repr,
    )
    assert rows(spark.read.parquet(f"{out}/order_details")) == KEPT_DETAILS
    # Orders 11 and 13 went first, and their lines went with them.
    lacking = run.rejects["order_details"].select("orderDetailId", "missingParent")
    assert rows(lacking) == [(2, "order"), (4, "product"), (5, "order"), (6, "order"), (7, "order")]
    assert run.rejects.keys() == {"order", "order_details"}
    assert rows(run.report) == REPORT


@pytest.fixture
def bronze(dirty, tmp_path):
    for name, df in dirty.items():
        df.write.parquet(f"{tmp_path}/bronze/{name}")
    return f"{tmp_path}/bronze"


def test_cleansing_of_written_tables(spark, bronze, tmp_path):
    run = run_silver(spark, ENTITIES, bronze, f"{tmp_path}/silver")
    assert rows(run.report) == REPORT
    assert rows(spark.read.parquet(f"{tmp_path}/silver/order_details")) == KEPT_DETAILS
    assert rows(run.rejects["order_details"].select("orderDetailId")) == [(2,), (4,), (5,), (6,), (7,)]
    assert [r.orderId for r in run.rejects["order"].collect()] in ([11, 13], [13, 11])
    sample = run.sample("order_details", ("orderDetailId",))
    assert rows(reject_lines(sample))[1] == ("orderDetailId=4 order=12 product=7",)


def test_every_row_may_be_an_orphan(spark, bronze, dirty, tmp_path):
    frame(spark, "region", [(77, "Nowhere")]).write.mode("overwrite").parquet(f"{bronze}/region")
    run = run_silver(spark, ENTITIES, bronze, f"{tmp_path}/silver")
    assert rows(run.report)[:2] == [("order", 5, 4, 4, 0), ("order_details", 8, 7, 7, 0)]
    assert spark.read.parquet(f"{tmp_path}/silver/order_details").count() == 0


def test_an_empty_entity_stops_cleansing(spark, bronze, tmp_path):
    frame(spark, "product", []).write.mode("overwrite").parquet(f"{bronze}/product")
    with pytest.raises(ValueError, match="no rows in: product"):
        run_silver(spark, ENTITIES, bronze, f"{tmp_path}/silver")
    assert not (tmp_path / "silver").exists()


def test_a_bronze_table_of_another_type_is_refused(spark, bronze, tmp_path):
    spark.sql("select 'one' as regionId, 'x' as regionName").write.mode("overwrite").parquet(
        f"{bronze}/region"
    )
    with pytest.raises(TypeError, match="regionId is string, not int"):
        run_silver(spark, ENTITIES, bronze, f"{tmp_path}/silver")


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_timestamps(spark, conf, ansi):
    conf({"spark.sql.ansi.enabled": ansi})
    texts = ["2024-01-05T10:00:00", "2024-01-05 10:00:00", "2024-02-30", "junk", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "ts string")
    typed = [r[0] for r in type_timestamps(df, ("ts",)).collect()]
    assert typed == [dt.datetime(2024, 1, 5, 10)] * 2 + [None] * 4


def write_inputs(folder, orders=50, details=150):
    """4 regions, 10 products, orders in four states, and lines that all have parents."""
    rng = random.Random(1)
    cents = lambda: rng.randrange(500, 10_000) / 100
    lines = {
        "region": ["regionId,regionName"] + [f"{i},{n}" for i, n in enumerate(("North", "South", "East", "West"), 1)],
        "product": ["productId,productName,category,unitPrice"]
        + [f"{i},Product_{i},{rng.choice(('Home', 'Toys'))},{cents()}" for i in range(1, 11)],
        "order": ["orderId,orderTs,regionId,customerId,status"]
        + [
            f"{i},2024-01-{rng.randrange(1, 29):02d}T10:00:00,{rng.randrange(1, 5)},"
            f"{rng.randrange(1000, 1200)},{rng.choice(('NEW', 'SHIPPED', 'CANCELLED', 'RETURNED'))}"
            for i in range(1, orders + 1)
        ],
        "order_details": ["orderDetailId,orderId,productId,quantity,unitPrice"]
        + [
            f"{i},{rng.randrange(1, orders + 1)},{rng.randrange(1, 11)},{rng.randrange(1, 11)},{cents()}"
            for i in range(1, details + 1)
        ],
    }
    sources = {}
    for name, text in lines.items():
        (folder / name).mkdir(parents=True)
        (folder / name / "part.csv").write_text("\n".join(text) + "\n")
        sources[name] = Source("file", path=str(folder / name))
    return sources, lines


def test_pipeline(spark, tmp_path):
    sources, lines = write_inputs(tmp_path / "in")
    out = {layer: f"{tmp_path}/{layer}" for layer in ("bronze", "silver", "gold")}
    run = run_pipeline(spark, sources, **out)
    assert [(c.entity, c.written, c.dropped) for c in run.ingested] == [
        ("region", 4, 0), ("product", 10, 0), ("order", 50, 0), ("order_details", 150, 0),
    ]
    fact = spark.read.parquet(f"{out['gold']}/{FACT}")
    totals = spark.read.parquet(f"{out['gold']}/{DAILY_SALES}")
    details = spark.read.parquet(f"{out['silver']}/order_details")
    assert run.gold_rows == {FACT: 150, DAILY_SALES: totals.count()}
    assert fact.count() == details.count() == 150
    assert fact.schema["orderTs"].dataType == T.TimestampType()
    assert reconcile_revenue(fact, totals, details).first().reconciled
    expected = sum(int(q) * float(p) for q, p in (t.split(",")[3:] for t in lines["order_details"][1:]))
    assert totals.agg(F.sum("totalRevenue")).first()[0] == pytest.approx(expected)
    monthly = sales_by_period(
        fact,
        spark.read.parquet(f"{out['silver']}/product"),
        spark.read.parquet(f"{out['silver']}/region"),
        "month",
    )
    assert {r[0] for r in monthly.select("monthStart").collect()} == {dt.date(2024, 1, 1)}

    # Once more over the old output.
    again = run_pipeline(spark, sources, **out, money_scale=2)
    assert again.gold_rows == run.gold_rows


def test_text_may_say_that_a_price_is_no_number(spark, tmp_path):
    sources, _ = write_inputs(tmp_path / "in")
    with open(f"{sources['product'].path}/part.csv", "a") as text:
        text.write("11,Product_11,Toys,NaN\n")
    counts = {c.entity: c for c in run_bronze(spark, sources, ENTITIES, f"{tmp_path}/bronze")}
    assert (counts["product"].written, counts["product"].dropped) == (11, 0)


def test_job(spark, tmp_path, capsys):
    sources, lines = write_inputs(tmp_path / "in")
    with open(f"{sources['order_details'].path}/rest.csv", "w") as more:
        more.write("151,999,1,1,1.0\n151,999,1,1,1.0\n")
    args = [f"--{n.replace('_', '-')}={s.path}" for n, s in sources.items()]
    main([*args, f"--out={tmp_path}/out"])
    said = capsys.readouterr().out.splitlines()
    used = sorted({int(t.split(",")[2]) for t in lines["order"][1:]})
    assert said[:5] == [
        "ingested region: 4 rows, 0 dropped",
        "ingested product: 10 rows, 0 dropped",
        "ingested order: 50 rows, 0 dropped",
        "ingested order_details: 152 rows, 0 dropped",
        "orders with a region: 50",
    ]
    assert "cleansed order_details: 152 in, 151 unique, 1 orphaned, 150 kept" in said
    assert "rejected orderDetailId=151 order=999 product=1" in said
    assert [t for t in said if t.startswith("region")] == [
        f"region {r} has ordinal {i}" for i, r in enumerate(used)
    ]
    assert sum(t.startswith("product") for t in said) == 3
    assert f"wrote {FACT}: 150 rows" in said


def test_job_wants_a_connection_for_jdbc(tmp_path, capsys):
    args = ["--order=/o", "--order-details=/d", "--out=/x", "--region=/r"]
    with pytest.raises(SystemExit):
        parse(args)
    assert "--jdbc-url" in capsys.readouterr().err
    secret = tmp_path / "password"
    secret.write_text("hush\n")
    parsed = parse(
        [*args, "--jdbc-url=jdbc:x:y", "--jdbc-user=u", f"--jdbc-password-file={secret}",
         "--product-split=1:900:4"]
    )
    sources = sources_of(parsed)
    assert {n: s.kind for n, s in sources.items()} == {
        "order": "file", "order_details": "file", "region": "file", "product": "jdbc",
    }
    assert sources["product"].connection.password == "hush"
    assert sources["product"].partitioning == JdbcPartitioning("productId", "1", "900", 4)


def test_bronze_opens_all_sources_before_it_writes(spark, tmp_path):
    sources, _ = write_inputs(tmp_path / "in")
    sources["order_details"] = Source("ftp")
    with pytest.raises(ValueError, match="unknown source kind"):
        run_bronze(spark, sources, ENTITIES, f"{tmp_path}/bronze")
    assert not (tmp_path / "bronze").exists()


def test_bronze_drops_and_counts_database_rows_without_required_values(spark, tmp_path, monkeypatch):
    sources, _ = write_inputs(tmp_path / "in")

    def fake(spark, connection, dbtable, partitioning):
        return spark.sql(
            """select * from values (1BD, 'a', null, 1.5BD), (null, 'b', 'c', 2.0BD),
            (3BD, null, 'c', null) as t(productId, productName, category, unitPrice)"""
        )

    monkeypatch.setattr(spec, "read_jdbc", fake)
    connection = JdbcConnection("jdbc:postgresql://db/shop", "reader", "secret")
    sources["product"] = Source("jdbc", connection=connection, dbtable=entity_query(ENTITIES["product"]))
    counts = {c.entity: c for c in run_bronze(spark, sources, ENTITIES, f"{tmp_path}/bronze")}
    assert (counts["product"].written, counts["product"].dropped) == (1, 2)
    assert rows(spark.read.parquet(f"{tmp_path}/bronze/product")) == [(1, "a", None, 1.5)]


@pytest.mark.parametrize(
    "output,other",
    [
        ("/data/out", "/data/out"),
        ("/data/out", "/data/out/in"),
        ("/data", "/data/in"),
        ("/data/x/../out/", "/data/out"),
        ("file:///data/out", "/data/out"),
        ("hdfs://a/data", "hdfs://a/data/in"),
    ],
)
def test_overlapping_paths(output, other):
    with pytest.raises(ValueError, match="overlap"):
        require_separate_paths([other], [output])
    with pytest.raises(ValueError, match="overlap"):
        require_separate_paths([], [output, other])


def test_separate_paths():
    require_separate_paths(["/data/in", "/data/out2"], ["/data/out", "/data/output"])
    require_separate_paths(["hdfs://a/data"], ["hdfs://b/data", "file:///data"])


def test_rejected_lines_are_stored_with_the_kept_ones(spark, tmp_path):
    sources, _ = write_inputs(tmp_path / "in")
    with open(f"{sources['order_details'].path}/rest.csv", "w") as more:
        more.write("151,999,1,1,1.0\n152,1,999,1,1.0\n153,999,999,1,1.0\n")
    run = run_pipeline(spark, sources, f"{tmp_path}/bronze", f"{tmp_path}/silver", f"{tmp_path}/gold")
    rejects = run.cleansed.rejects["order_details"]
    assert all("/silver/_rejects/order_details/" in f for f in rejects.inputFiles())
    assert rows(rejects.select("orderDetailId", "missingParent")) == [(151, "order"), (152, "product"), (153, "order")]
    assert spark.read.parquet(f"{tmp_path}/silver/order_details").count() == 150
