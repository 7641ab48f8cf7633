"""The pipeline as a job: ``spark-submit orderloom/__main__.py`` or ``python -m orderloom``.

Master and resources come from the submit command; only SQL settings are set here.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from orderloom.entities import order_entities
from orderloom.operators.ordinals import surrogate_ordinals
from orderloom.operators.quality import first_rows
from orderloom.operators.sales import MONEY_SCALE, marked_up_prices
from orderloom.plans.pipeline import PipelineRun, run_pipeline
from orderloom.plans.silver import reject_lines
from orderloom.session import tune
from orderloom.sources.jdbc import JdbcConnection, JdbcPartitioning, JdbcRanges, Partitioning, entity_query
from orderloom.sources.spec import Source

JDBC = "jdbc"
JDBC_ENTITIES = ("product", "region")
ORDINALS = "region_ordinals"


def parse(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="orderloom", description=__doc__)
    parser.add_argument("--order", required=True, help="folder or file of order lines")
    parser.add_argument("--order-details", required=True)
    for name in JDBC_ENTITIES:
        parser.add_argument(f"--{name}", default=JDBC, help=f"a path, or {JDBC} (default)")
        parser.add_argument(
            f"--{name}-split",
            metavar="[LOWER:UPPER:]PARTS",
            help=f"read {name} from the database in ranges of its id; without bounds it is asked for them",
        )
    parser.add_argument("--out", required=True, help="gets bronze, silver and gold")
    parser.add_argument("--jdbc-url")
    parser.add_argument("--jdbc-user")
    parser.add_argument("--jdbc-password-file", type=Path)
    parser.add_argument("--jdbc-driver", default="org.postgresql.Driver")
    parser.add_argument(
        "--money-scale", type=int, default=MONEY_SCALE, help="decimals of the amounts added"
    )
    args = parser.parse_args(argv)
    wants_jdbc = JDBC in (args.product, args.region)
    if wants_jdbc and not (args.jdbc_url and args.jdbc_user and args.jdbc_password_file):
        parser.error("a jdbc source needs --jdbc-url, --jdbc-user and --jdbc-password-file")
    return args


def sources_of(args: argparse.Namespace) -> dict[str, Source]:
    sources = {
        "order": Source("file", path=args.order),
        "order_details": Source("file", path=args.order_details),
    }
    entities = order_entities()
    for name in JDBC_ENTITIES:
        given = getattr(args, name)
        if given == JDBC:
            password = args.jdbc_password_file.read_text().strip()
            connection = JdbcConnection(args.jdbc_url, args.jdbc_user, password, args.jdbc_driver)
            sources[name] = Source(
                JDBC,
                connection=connection,
                dbtable=entity_query(entities[name]),
                partitioning=_split(getattr(args, f"{name}_split"), entities[name].primary_key[0]),
            )
        else:
            sources[name] = Source("file", path=given)
    return sources


def _split(text: str | None, column: str) -> Partitioning | None:
    if text is None:
        return None
    if ":" not in text:
        return JdbcRanges(column, int(text))
    lower, upper, parts = text.split(":")
    return JdbcPartitioning(column, lower, upper, int(parts))


def describe(spark: SparkSession, run: PipelineRun, out: str) -> list[str]:
    """What happened, a line each. Rejects and prices are samples; region ordinals are all
    listed, and stored as a gold table."""
    lines = [f"ingested {c.entity}: {c.written} rows, {c.dropped} dropped" for c in run.ingested]
    mapped = spark.read.parquet(f"{out}/bronze/order").agg(F.count_distinct("orderId")).first()[0]
    lines.append(f"orders with a region: {mapped}")
    lines += [
        f"cleansed {r.entity}: {r.inputRows} in, {r.dedupedRows} unique, "
        f"{r.orphanRows} orphaned, {r.keptRows} kept"
        for r in run.cleansed.report.collect()
    ]
    sample = run.cleansed.sample("order_details", ("orderDetailId",))
    lines += [f"rejected {r.reject}" for r in reject_lines(sample).collect()]
    used = surrogate_ordinals(spark.read.parquet(f"{out}/silver/order"), "regionId")
    used.write.mode("overwrite").parquet(f"{out}/gold/{ORDINALS}")
    stored = spark.read.parquet(f"{out}/gold/{ORDINALS}").orderBy("ordinal")
    lines += [f"region {r.regionId} has ordinal {r.ordinal}" for r in stored.toLocalIterator()]
    prices = marked_up_prices(spark.read.parquet(f"{out}/silver/product"))
    lines += [
        f"product {r.productId} marked up to {r.markedUpPrice}"
        for r in first_rows(prices, ["productId"], 3).collect()
    ]
    return lines + [f"wrote {name}: {rows} rows" for name, rows in run.gold_rows.items()]


def main(argv: Sequence[str] | None = None) -> None:
    args = parse(argv)
    spark = SparkSession.builder.appName("orderloom").getOrCreate()
    tune(spark, spark.read.text(args.order), spark.read.text(args.order_details))
    layers = {n: f"{args.out.rstrip('/')}/{n}" for n in ("bronze", "silver", "gold")}
    run = run_pipeline(
        spark, sources_of(args), **layers, entities=order_entities(), money_scale=args.money_scale
    )
    print("\n".join(describe(spark, run, args.out.rstrip("/"))))


if __name__ == "__main__":
    main()
