import datetime as dt
import re

import pytest

from orderloom.operators import sales
from tests.conftest import final_plan, rows

JAN = dt.datetime(2024, 1, 31, 23, 59, 59)
FEB = dt.datetime(2024, 2, 1, 0, 0, 0)


@pytest.fixture
def model(spark):
    return {
        "regions": spark.createDataFrame([(1, "North"), (2, "South")], "regionId int, regionName string"),
        "products": spark.createDataFrame(
            [(1, "Lamp", "Home", 9.0), (2, "Kite", "Toys", 4.0)],
            "productId int, productName string, category string, unitPrice double",
        ),
        "orders": spark.createDataFrame(
            [
                (10, JAN, 1, 100, "NEW"),
                (11, FEB, 1, 101, "CANCELLED"),
                (12, FEB, 1, 100, "RETURNED"),
                (13, None, 2, 102, "NEW"),
            ],
            "orderId int, orderTs timestamp, regionId int, customerId int, status string",
        ),
        "details": spark.createDataFrame(
            [
                (1, 10, 1, 2, 8.5),
                (2, 11, 1, 1, 8.0),
                (3, 11, 1, 3, 8.0),
                (4, 12, 1, 1, 7.0),
                (5, 12, 2, 5, 0.1),
                (6, 13, 2, 1, 4.0),
            ],
            "orderDetailId int, orderId int, productId int, quantity int, unitPrice double",
        ),
    }


@pytest.fixture
def fact(model):
    return sales.order_lines_fact(
        model["details"], model["orders"], model["products"], model["regions"]
    )


def test_fact_schema(fact):
    assert [(f.name, f.dataType.simpleString()) for f in fact.schema.fields] == [
        ("orderDetailId", "int"), ("orderId", "int"), ("productId", "int"), ("regionId", "int"),
        ("quantity", "int"), ("unitPrice", "double"), ("lineRevenue", "double"),
        ("productName", "string"), ("category", "string"), ("catalogUnitPrice", "double"),
        ("regionName", "string"), ("orderTs", "timestamp"), ("orderDate", "date"),
        ("customerId", "int"), ("status", "string"),
    ]


def test_fact_prices_lines_by_the_line(fact):
    first = fact.where("orderDetailId = 1").first()
    assert (first.lineRevenue, first.unitPrice, first.catalogUnitPrice) == (17.0, 8.5, 9.0)
    assert first.orderDate == dt.date(2024, 1, 31)
    assert fact.count() == 6


def test_daily_sales(model, fact):
    daily = sales.sales_by_period(fact, model["products"], model["regions"])
    assert [(f.name, f.dataType.simpleString()) for f in daily.schema.fields] == [
        ("orderDate", "date"), ("regionId", "int"), ("regionName", "string"),
        ("productId", "int"), ("productName", "string"), ("totalRevenue", "double"),
        ("totalQuantity", "bigint"), ("orderCount", "bigint"),
    ]
    # Cancelled and returned orders count; an order without a date has its own group.
    assert rows(daily) == sorted(
        [
            (dt.date(2024, 1, 31), 1, "North", 1, "Lamp", 17.0, 2, 1),
            (dt.date(2024, 2, 1), 1, "North", 1, "Lamp", 39.0, 5, 2),
            (dt.date(2024, 2, 1), 1, "North", 2, "Kite", 0.5, 5, 1),
            (None, 2, "South", 2, "Kite", 4.0, 1, 1),
        ],
        key=repr,
    )


def test_coarser_grains_count_an_order_once(model, fact):
    weekly = sales.sales_by_period(fact, model["products"], model["regions"], "week", 2)
    assert (dt.date(2024, 1, 29), 1, "North", 1, "Lamp", 56.0, 7, 3) in rows(weekly)
    monthly = sales.sales_by_period(fact, model["products"], model["regions"], "month", 2)
    assert (dt.date(2024, 2, 1), 1, "North", 1, "Lamp", 39.0, 5, 2) in rows(monthly)


def test_fact_and_bare_lines_give_the_same_totals(model, fact):
    bare = sales.sale_lines(model["details"], model["orders"])
    dims = model["products"], model["regions"]
    assert rows(sales.sales_by_period(bare, *dims)) == rows(sales.sales_by_period(fact, *dims))


def test_lines_without_product_or_region_drop_out(spark, model):
    stray = spark.createDataFrame(
        [(7, 10, 99, 1, 1.0), (8, 99, 1, 1, 1.0)], model["details"].schema
    )
    details = model["details"].union(stray)
    fact = sales.order_lines_fact(details, model["orders"], model["products"], model["regions"])
    assert fact.count() == 6
    lines = sales.sale_lines(details, model["orders"])
    dims = model["products"], model["regions"]
    assert rows(sales.sales_by_period(lines, *dims)) == rows(sales.sales_by_period(fact, *dims))


def test_markup(model):
    assert rows(sales.marked_up_prices(model["products"])) == [(1, 9.0 * 1.1), (2, 4.0 * 1.1)]


def test_reconciliation(model, fact):
    daily = sales.sales_by_period(fact, model["products"], model["regions"])
    assert rows(sales.reconcile_revenue(fact, daily, model["details"])) == [(6, 6, 60.5, 60.5, True)]
    short = daily.where("productId = 1")
    assert rows(sales.reconcile_revenue(fact, short, model["details"])) == [(6, 6, 60.5, 56.0, False)]
    fewer = model["details"].where("orderId <> 13")
    assert sales.reconcile_revenue(fact, daily, fewer).first().reconciled is False


def test_distinct_orders_reuse_the_partitioning_of_the_join(model):
    lines = sales.sale_lines(model["details"], model["orders"])
    plan = final_plan(sales.sales_by_period(lines, model["products"], model["regions"]))
    shuffles = re.findall(r"Exchange hashpartitioning\((.*?)\), ENSURE", plan)
    by_order = [s for s in shuffles if "orderId" in s]
    # Lines and orders are shuffled by order, and nothing by group and order.
    assert len(by_order) == 2
    assert not any("orderDate" in s for s in by_order)
