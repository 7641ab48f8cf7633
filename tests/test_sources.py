from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderloom.__main__ import _split
from orderloom.entities import order_entities
from orderloom.sources import jdbc, spec
from orderloom.sources.jdbc import (
    JdbcConnection,
    JdbcPartitioning,
    entity_query,
    jdbc_options,
)
from orderloom.sources.parquet import (
    coerce_schema, conform, observe, read_parquet, read_rest, refresh_partitions, write_parquet, write_split,
)
from orderloom.sources.spec import Source, read_source
from orderloom.sources.text import header_line, parse_lines, read_body_lines, read_text
from tests.conftest import final_plan, rows

REGION = order_entities()["region"].raw


def write_files(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder)


def test_every_copy_of_the_header_goes(spark, tmp_path):
    path = write_files(tmp_path / "in", a="id,name\n1,x\nid,name\n", b="id,name\n2,y\n")
    assert rows(read_body_lines(spark, path)) == [("1,x",), ("2,y",)]


def test_a_larger_file_without_header_keeps_its_first_line(spark, tmp_path):
    big = "".join(f"{i},n\n" for i in range(2, 3000))
    path = write_files(tmp_path / "in", a="id,name\n1,x\n", b=big)
    assert header_line(spark, path) == "id,name"
    assert read_text(spark, path, REGION).count() == 2999


def test_leading_empty_files_have_no_header(spark, tmp_path):
    path = write_files(tmp_path / "in with space", a="", b="id,name\n1,x\n")
    assert rows(read_text(spark, path, REGION)) == [(1, "x")]


def test_names_are_no_patterns(spark, tmp_path):
    path = write_files(tmp_path / "in", **{"part{0}": "id,name\n1,x\n", "z[a]*": "2,y\n"})
    assert rows(read_text(spark, path, REGION)) == [(1, "x"), (2, "y")]


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("line", ["BAD,2,3,4,5.5", "1,2,3,BAD,5.5", "1,2,3,4,BAD", "1,2,3,4"])
def test_a_bad_field_fails_whatever_is_read(spark, conf, ansi, line):
    conf({"spark.sql.ansi.enabled": ansi})
    schema = order_entities()["order_details"].raw
    lines = spark.createDataFrame([("1,2,3,4,5.5",), (line,)], "value string")
    for read in (
        lambda df: df.count(),
        lambda df: df.agg(F.sum("quantity")).collect(),
        lambda df: df.select("orderId", "unitPrice").collect(),
    ):
        with pytest.raises(PySparkException, match="not a line of"):
            read(parse_lines(lines, schema))


def test_junk_from_a_database_becomes_null(spark):
    df = spark.sql("select 'abc' as productId, 'n' as productName, null as category, '2.5' as unitPrice")
    assert rows(coerce_schema(df, order_entities()["product"].raw, permissive=True)) == [
        (None, "n", None, 2.5)
    ]
    large = df.withColumn("productId", F.lit(99999999999))
    assert rows(coerce_schema(large, order_entities()["product"].raw, permissive=True))[0][0] is None
    with pytest.raises(PySparkException):
        coerce_schema(df, order_entities()["product"].raw).collect()


def test_no_lines_at_all(spark, tmp_path):
    with pytest.raises(ValueError, match="no lines"):
        read_text(spark, write_files(tmp_path / "in", a="", b=""), REGION)


def test_header_only(spark, tmp_path):
    assert read_text(spark, write_files(tmp_path / "in", a="id,name\n"), REGION).isEmpty()


def test_missing_path_fails_at_once(spark, tmp_path):
    with pytest.raises(PySparkException, match="PATH_NOT_FOUND"):
        read_text(spark, str(tmp_path / "none"), REGION)


def test_no_quoting_surplus_and_empty_fields(spark, tmp_path):
    path = write_files(tmp_path / "in", a='id,name\n2,"q,z"\n3,\n4,y,extra\n5, p \n')
    assert rows(read_text(spark, path, REGION)) == [(2, '"q'), (3, ""), (4, "y"), (5, " p ")]


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize(
    "line", ["7x,a", "7", "", " 7,a", "7 ,a", "\t7,a", "7\x7f,a", "\x007,a", "7.0,a"]
)
def test_a_bad_line_fails_the_job(spark, tmp_path, conf, line, ansi):
    conf({"spark.sql.ansi.enabled": ansi})
    path = write_files(tmp_path / "in", a=f"id,name\n1,x\n{line}\n2,y\n")
    with pytest.raises(PySparkException, match="not a line of struct<regionId:int,regionName"):
        read_text(spark, path, REGION).collect()


def test_padding_matters_in_integer_fields_only(spark):
    schema = order_entities()["order_details"].raw
    def parse(*lines):
        return rows(parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"), schema))

    assert parse("1,002,+3,-4, 5.5 ") == [(1, 2, 3, -4, 5.5)]
    for line in ("1,2,3,4 ,5.5", "1, 2,3,4,5.5", "1,2,3,\x1c4,5.5"):
        with pytest.raises(PySparkException, match="not a line of"):
            parse("1,2,3,4,5.5", line)


def test_coercion_by_name(spark):
    df = spark.sql("select 2.50BD as UNITPRICE, 7L as productid, 'n' as ProductName, null as category")
    out = coerce_schema(df, order_entities()["product"].raw)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema.fields] == [
        ("productId", "int"), ("productName", "string"), ("category", "string"),
        ("unitPrice", "double"),
    ]
    assert rows(out) == [(7, "n", None, 2.5)]


def test_conform_widens_and_refuses(spark):
    schema = T.StructType().add("a", T.LongType()).add("b", T.DoubleType())
    ok = conform(spark.sql("select 1 as a, cast(2 as float) as b, 3 as c"), schema)
    assert ok.schema.simpleString() == "struct<a:bigint,b:double>"
    with pytest.raises(TypeError, match="a is double, not bigint; b is missing"):
        conform(spark.sql("select 1D as a"), schema)


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_sink_counts_and_overwrites(spark, tmp_path, n):
    path = str(tmp_path / "out")
    write_parquet(spark.range(10), path)
    assert write_parquet(spark.range(n).where("id >= 0"), path) == n
    assert spark.read.parquet(path).count() == n


def test_sink_counts_an_emptied_join(spark, tmp_path):
    df = spark.range(10).join(spark.range(0), "id")
    assert write_parquet(df, str(tmp_path / "out")) == 0


def test_sink_is_one_job(spark, tmp_path):
    group = str(tmp_path)
    spark.sparkContext.setJobGroup(group, "sink")
    try:
        write_parquet(spark.range(100), str(tmp_path / "out"))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setJobGroup("tests", "tests")
    assert len(jobs) == 1


def test_sink_can_partition(spark, tmp_path):
    path = str(tmp_path / "out")
    assert write_parquet(spark.range(10).withColumn("p", F.col("id") % 2), path, ["p"]) == 10
    assert (tmp_path / "out" / "p=0").is_dir()


def test_observation_counts_what_a_later_filter_drops(spark, tmp_path):
    df, seen = observe(spark.range(100), {"all": F.count(F.lit(1)), "odd": F.count_if(F.col("id") % 2 == 1)})
    assert write_parquet(df.where("id < 10"), str(tmp_path / "out")) == 10
    assert seen.get == {"all": 100, "odd": 50}


def test_scan_reads_only_the_columns_of_the_schema(spark, tmp_path):
    path = str(tmp_path / "wide")
    spark.range(5).selectExpr("id as a", "id as b", "id as c").write.parquet(path)
    plan = final_plan(read_parquet(spark, path, T.StructType().add("b", T.LongType())))
    assert "ReadSchema: struct<b:bigint>" in plan


CONNECTION = JdbcConnection("jdbc:postgresql://db/shop", "reader", "secret")


def test_jdbc_options():
    assert jdbc_options(CONNECTION, "product") == {
        "url": "jdbc:postgresql://db/shop", "user": "reader", "password": "secret",
        "driver": "org.postgresql.Driver", "dbtable": "product",
    }
    split = jdbc_options(CONNECTION, "product", JdbcPartitioning("product_id", "0", "1000", 8))
    assert (split["partitionColumn"], split["numPartitions"]) == ("product_id", "8")
    assert "secret" not in repr(CONNECTION)


def test_jdbc_queries_name_the_columns_of_the_entities():
    assert entity_query(order_entities()["region"]) == (
        '(SELECT region_id AS "regionId", region_name AS "regionName" FROM region) AS region_rows'
    )
    assert 'unit_price AS "unitPrice" FROM shop.items' in entity_query(
        order_entities()["product"], "shop.items"
    )


def test_source_choice(spark, tmp_path, monkeypatch):
    path = write_files(tmp_path / "in", a="id,name\n1,x\n")
    assert rows(read_source(spark, Source("file", path=path), REGION)) == [(1, "x")]

    asked = []

    def fake(spark, connection, dbtable, partitioning):
        asked.append((connection, dbtable, partitioning))
        return spark.sql("select 1BD as REGIONID, 'x' as regionName")

    monkeypatch.setattr(spec, "read_jdbc", fake)
    source = Source("jdbc", connection=CONNECTION, dbtable=entity_query(order_entities()["region"]))
    assert rows(read_source(spark, source, REGION)) == [(1, "x")]
    assert asked == [(CONNECTION, source.dbtable, None)]


@pytest.mark.parametrize("source", [Source("ftp"), Source("file"), Source("jdbc", dbtable="t")])
def test_bad_sources(spark, source):
    with pytest.raises(ValueError):
        read_source(spark, source, REGION)


def test_a_line_is_split_once_and_a_cell_cast_once(spark):
    schema = T.StructType().add("a", T.IntegerType()).add("b", T.DoubleType()).add("c", T.StringType())
    lines = spark.createDataFrame([("1,2.5,x",), ("-3,4,",)], "value string")
    df = parse_lines(lines, schema)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("try_cast(") == 2
    # Columns that are not read are cast and tested all the same.
    one = df.select("b")
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("try_cast(") == 2
    assert rows(one) == [(2.5,), (4.0,)]
    bad = spark.createDataFrame([("1,2.5,x",), ("1x,4,",)], "value string")
    with pytest.raises(Exception, match="not a line of"):
        parse_lines(bad, schema).select("c").collect()


def test_split_sink(spark, tmp_path):
    df = spark.range(100).select("id", F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("by"))
    kept, rest = f"{tmp_path}/t/kept", f"{tmp_path}/t/_rest/kept"
    for _ in range(2):
        assert write_split(df, "by", "p0", kept, rest) == {"rows": 100, "kept": 34}
        assert rows(spark.read.parquet(kept)) == sorted(((i,) for i in range(0, 100, 3)), key=repr)
        others = read_rest(spark, rest, df.schema)
        assert rows(others) == rows(df.where("by <> 'p0'"))
    assert sorted(p.name for p in (tmp_path / "t").iterdir()) == ["_rest", "kept"]
    # Nothing left to keep, or nothing else.
    assert write_split(df.where("by = 'p1'"), "by", "p0", kept, rest)["kept"] == 0
    assert spark.read.parquet(kept).count() == 0 and spark.read.parquet(kept).columns == ["id"]
    write_split(df.where("by = 'p0'"), "by", "p0", kept, rest)
    assert read_rest(spark, rest, df.schema).collect() == []


def test_a_failed_split_leaves_the_old_tables(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).cast("string").alias("by"))
    kept, rest = f"{tmp_path}/kept", f"{tmp_path}/_rest"
    write_split(df, "by", "0", kept, rest)
    broken = df.withColumn("id", F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("no")).cast("bigint")))
    with pytest.raises(Exception, match="no"):
        write_split(broken, "by", "0", kept, rest)
    assert spark.read.parquet(kept).count() == 5 and read_rest(spark, rest, df.schema).count() == 5


def test_split_needs_no_sort(spark, tmp_path, conf):
    conf({"spark.sql.maxConcurrentOutputFileWriters": "8"})
    df = spark.range(10).select("id", (F.col("id") % 2).cast("string").alias("by"))
    df.createOrReplaceTempView("split_rows")
    plan = spark.sql("EXPLAIN CREATE TABLE split_t USING parquet PARTITIONED BY (by) AS SELECT * FROM split_rows").first()[0]
    assert "Sort" not in plan


def test_hash_predicates_split_rows():
    n = 7
    conditions = jdbc.hash_predicates(jdbc.JdbcHashes("sku", n, "LENGTH({column}) - 5"))
    con = duckdb.connect()
    con.execute("""CREATE TABLE t AS SELECT repeat('x', i % 31) AS sku FROM range(1000) r(i)
                   UNION ALL SELECT NULL FROM range(5)""")
    # Negative hashes and nulls too: each row fulfils one condition.
    assert len(conditions) == n
    met = " + ".join(f"CAST(coalesce({c}, false) AS int)" for c in conditions)
    assert con.execute(f"SELECT min({met}), max({met}), count(*) FROM t").fetchone() == (1, 1, 1005)
    assert 'hashtext(CAST("sku" AS text))' in jdbc.hash_predicates(jdbc.JdbcHashes("sku", 2))[1]
    with pytest.raises(ValueError):
        jdbc.hash_predicates(jdbc.JdbcHashes("sku", 0))


def test_bounds_are_asked_for():
    con = duckdb.connect()
    con.execute("CREATE TABLE product AS SELECT i AS product_id FROM range(5, 900) r(i)")
    query = jdbc.bounds_query('(SELECT product_id AS "productId" FROM product) AS product_rows', "productId")
    assert con.execute(f"SELECT * FROM {query}").fetchall() == [(5, 899)]
    assert jdbc.bounds_query("product", 'a"b').count('"a""b"') == 2


@pytest.mark.parametrize(
    "low, high, bounds",
    [
        (5, 899, ("5", "899")),
        (Decimal("-1.5"), Decimal("7.2"), ("-2", "8")),
        (date(2020, 1, 1), date(2021, 1, 1), ("2020-01-01", "2021-01-01")),
        (datetime(2020, 1, 1, 3), datetime(2021, 1, 1), ("2020-01-01 03:00:00", "2021-01-01 00:00:00")),
        (None, None, None),
        (4, 4, None),
    ],
)
def test_bounds_become_ranges(low, high, bounds):
    found = jdbc.bounded(jdbc.JdbcRanges("k", 8), low, high)
    assert found == (JdbcPartitioning("k", *bounds, 8) if bounds else None)


def test_text_has_no_ranges():
    with pytest.raises(TypeError, match="JdbcHashes"):
        jdbc.bounded(jdbc.JdbcRanges("k", 8), "a", "z")


class Reader:
    """Stands in for a session's reader, and notes what it is asked for."""

    def __init__(self):
        self.asked, self.read = [], self

    def format(self, name):
        assert name == "jdbc"
        return self

    def options(self, **options):
        self.asked.append(options)
        return self

    def load(self):
        return self

    def first(self):
        return (1, 1000)

    def jdbc(self, url, table, predicates, properties):
        self.asked.append((url, table, predicates, properties))
        return self


def test_scans_of_large_tables():
    reader = Reader()
    jdbc.read_jdbc(reader, CONNECTION, "product", jdbc.JdbcRanges("product_id", 8))
    bounds, scan = reader.asked
    assert bounds["dbtable"] == jdbc.bounds_query("product", "product_id")
    assert scan == jdbc_options(CONNECTION, "product", JdbcPartitioning("product_id", "1", "1000", 8))

    reader, hashes = Reader(), jdbc.JdbcHashes("sku", 3)
    jdbc.read_jdbc(reader, CONNECTION, "product", hashes)
    login = {"user": "reader", "password": "secret", "driver": "org.postgresql.Driver"}
    assert reader.asked == [(CONNECTION.url, "product", jdbc.hash_predicates(hashes), login)]


def test_partitions_are_refreshed(spark, tmp_path):
    path = str(tmp_path / "t")
    old = spark.range(90).selectExpr("id", "id % 3 AS day", "'old' AS v")
    assert refresh_partitions(old, path, ["day"]) == 90
    new = spark.range(5).selectExpr("id", "IF(id = 4, NULL, id % 2 + 2) AS day", "'new' AS v")
    assert refresh_partitions(new, path, ["day"]) == 5
    found = spark.read.parquet(path).groupBy("day", "v").count()
    assert set(rows(found)) == {(0, "old", 30), (1, "old", 30), (2, "new", 2), (3, "new", 2), (None, "new", 1)}
    # The table itself may be read for it, and no rows replace nothing.
    again = spark.read.parquet(path).where("day = 1").withColumn("v", F.lit("again"))
    assert refresh_partitions(again, path, ["day"]) == 30
    assert refresh_partitions(again.limit(0), path, ["day"]) == 0
    assert spark.read.parquet(path).where("v = 'again'").count() == 30
    assert spark.read.parquet(path).count() == 65


def test_a_failed_refresh_leaves_the_old_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).selectExpr("id", "id % 4 AS day")
    refresh_partitions(df, path, ["day"])
    broken = df.selectExpr("IF(id = 77, raise_error('stop'), id + 1000) AS id", "day")
    with pytest.raises(Exception, match="stop"):
        refresh_partitions(broken, path, ["day"])
    assert rows(spark.read.parquet(path)) == rows(df)


def test_refresh_writes_few_files_and_splits_a_hot_partition(spark, tmp_path, conf):
    conf({"spark.sql.adaptive.advisoryPartitionSizeInBytes": "800KB"})
    path = tmp_path / "t"
    day = "IF(id % 3 = 0, 0, id % 40) AS day"
    df = spark.range(0, 300_000, 1, 16).selectExpr("id", "xxhash64(id) AS v", day)
    refresh_partitions(df, str(path), ["day"])
    files = {d.name: len(list(d.glob("*.parquet"))) for d in path.iterdir() if d.is_dir()}
    assert files.pop("day=0") > 1
    # Those that share a task with the hot one are split with it; the others have one file, not 16.
    assert sorted(files.values())[len(files) // 2] == 1
    assert spark.read.parquet(str(path)).count() == 300_000


def test_split_option_of_the_job():
    assert _split(None, "productId") is None
    assert _split("64", "productId") == jdbc.JdbcRanges("productId", 64)
    assert _split("1:900:4", "productId") == JdbcPartitioning("productId", "1", "900", 4)
