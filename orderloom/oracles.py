"""The registered queries as plain SQL over the same tables, for an independent engine.

Written from the meaning of each query, not from its DataFrame form: orphans by NOT
EXISTS, deduplication by QUALIFY, money as decimals.
"""

from __future__ import annotations

REGIONS = 'regions AS (SELECT r_regionkey AS "regionId", r_name AS "regionName" FROM region)'

PRODUCTS = """products AS (
    SELECT p_partkey AS "productId", p_name AS "productName", p_type AS "category",
           p_retailprice AS "unitPrice"
    FROM part
)"""

ORDERS = """model_orders AS (
    SELECT o_orderkey AS "orderId", o_orderdate AS "orderTs", n_regionkey AS "regionId",
           o_custkey AS "customerId", o_orderstatus AS "status"
    FROM orders, customer, nation
    WHERE o_custkey = c_custkey AND c_nationkey = n_nationkey
)"""

DETAILS = """details AS (
    SELECT l_orderkey * 10 + l_linenumber AS "orderDetailId", l_orderkey AS "orderId",
           l_partkey AS "productId", CAST(l_quantity AS integer) AS "quantity",
           l_extendedprice AS "unitPrice"
    FROM lineitem
)"""

SOME_PRODUCTS = """some_products AS (
    SELECT p_partkey AS "productId" FROM part WHERE p_size <= 25
)"""

FACT = """fact AS (
    SELECT d."orderDetailId", d."orderId", d."productId", o."regionId", d."quantity",
           d."unitPrice", d."quantity" * d."unitPrice" AS "lineRevenue", p."productName",
           p."category", p."unitPrice" AS "catalogUnitPrice", r."regionName", o."orderTs",
           CAST(o."orderTs" AS date) AS "orderDate", o."customerId", o."status"
    FROM details d
    JOIN model_orders o ON o."orderId" = d."orderId"
    JOIN products p ON p."productId" = d."productId"
    JOIN regions r ON r."regionId" = o."regionId"
)"""

UNIQUE_DETAILS = """unique_details AS (
    SELECT * FROM details
    QUALIFY row_number() OVER (
        PARTITION BY "orderDetailId"
        ORDER BY "orderId" NULLS FIRST, "productId" NULLS FIRST, "quantity" NULLS FIRST,
                 "unitPrice" NULLS FIRST) = 1
)"""

FAULTY_ORDERS = """faulty_orders AS (
    SELECT "orderId",
           CASE WHEN "status" = 'P' THEN 'pending' ELSE CAST("orderTs" AS varchar) END AS "orderTs",
           CASE WHEN "orderTs" >= TIMESTAMP '1995-01-01' THEN CAST("regionId" AS bigint) END
               AS "regionId",
           "customerId", "status"
    FROM model_orders
)"""

CLEAN_ORDERS = """clean_orders AS (
    SELECT "orderId", TRY_CAST("orderTs" AS timestamp) AS "orderTs", "regionId", "customerId",
           "status"
    FROM faulty_orders o
    WHERE EXISTS (SELECT 1 FROM regions r
                  WHERE r."regionId" = o."regionId" AND r."regionName" <> 'ASIA')
)"""

JUDGED_DETAILS = """judged AS (
    SELECT d.*,
           CASE WHEN NOT EXISTS (SELECT 1 FROM clean_orders o WHERE o."orderId" = d."orderId")
                THEN 'order'
                WHEN NOT EXISTS (SELECT 1 FROM some_products p WHERE p."productId" = d."productId")
                THEN 'product' END AS "missingParent"
    FROM unique_details d
)"""

FOREIGN_PRODUCTS = """coerced AS (
    SELECT CASE WHEN p_size <= 40 AND p_size <> 9 THEN p_partkey END AS "productId",
           CASE WHEN p_name <> 'small ring' THEN p_name END AS "productName",
           p_type AS "category",
           CASE WHEN p_type <> 'PROMO' AND p_size <> 7 THEN p_retailprice END AS "unitPrice"
    FROM part
)"""


# The fact of the job on faulty orders and missing parents, as silver leaves them.
JOB_FACT = """fact AS (
    SELECT d."orderDetailId", d."orderId", d."productId", o."regionId", d."quantity",
           d."unitPrice", d."quantity" * d."unitPrice" AS "lineRevenue", p."productName",
           p."category", p."unitPrice" AS "catalogUnitPrice", r."regionName", o."orderTs",
           CAST(o."orderTs" AS date) AS "orderDate", o."customerId", o."status"
    FROM judged d
    JOIN clean_orders o ON o."orderId" = d."orderId"
    JOIN products p ON p."productId" = d."productId"
    JOIN regions r ON r."regionId" = o."regionId"
    WHERE d."missingParent" IS NULL
)"""

JOB_TOTALS = """totals AS (
    SELECT "orderDate", "regionId", "regionName", "productId", "productName",
           sum(CAST("lineRevenue" AS decimal(28, 2))) AS "totalRevenue",
           CAST(sum("quantity") AS bigint) AS "totalQuantity",
           count(DISTINCT "orderId") AS "orderCount"
    FROM fact GROUP BY ALL
)"""

RECONCILED = """
    SELECT f.n AS "factRows", d.n AS "detailRows", CAST(f.revenue AS double) AS "factRevenue",
           CAST(t.revenue AS double) AS "totalRevenue",
           f.n = d.n AND f.revenue = t.revenue AS "reconciled"
    FROM (SELECT count(*) AS n, sum(CAST("lineRevenue" AS decimal(28, 2))) AS revenue FROM fact) f,
         (SELECT sum("totalRevenue") AS revenue FROM totals) t,
         (SELECT count(*) AS n FROM {details}) d"""


def _with(*parts: str, select: str) -> str:
    return f"WITH {', '.join(parts)} {select}"


MODEL = (REGIONS, PRODUCTS, ORDERS, DETAILS)
SILVER = (REGIONS, ORDERS, DETAILS, SOME_PRODUCTS, UNIQUE_DETAILS, FAULTY_ORDERS, CLEAN_ORDERS,
          JUDGED_DETAILS)
REJECTED = _with(
    DETAILS, SOME_PRODUCTS, UNIQUE_DETAILS,
    select="""SELECT * FROM unique_details d WHERE NOT EXISTS (
        SELECT 1 FROM some_products p WHERE p."productId" = d."productId")""",
)


def _sales(period: str, name: str, where: str = "TRUE") -> str:
    return _with(
        *MODEL, FACT,
        select=f"""SELECT {period} AS "{name}", "regionId", "regionName", "productId",
            "productName",
            CAST(sum(CAST("lineRevenue" AS decimal(18, 2))) AS double) AS "totalRevenue",
            CAST(sum("quantity") AS bigint) AS "totalQuantity",
            count(DISTINCT "orderId") AS "orderCount"
        FROM fact WHERE {where}
        GROUP BY {period}, "regionId", "regionName", "productId", "productName" """,
    )


def _all_grains() -> str:
    starts = {"day": '"orderDate"'} | {
        g: f"CAST(date_trunc('{g}', \"orderDate\") AS date)" for g in ("week", "month")
    }
    grains = " UNION ALL ".join(
        f"""SELECT '{grain}' AS "grain", {start} AS "periodStart", * FROM fact"""
        for grain, start in starts.items()
    )
    return _with(
        *MODEL, FACT, f"grains AS ({grains})",
        select="""SELECT "grain", "periodStart", "regionId", "regionName", "productId", "productName",
            CAST(sum(CAST("lineRevenue" AS decimal(18, 2))) AS double) AS "totalRevenue",
            CAST(sum("quantity") AS bigint) AS "totalQuantity",
            count(DISTINCT "orderId") AS "orderCount"
        FROM grains
        GROUP BY "grain", "periodStart", "regionId", "regionName", "productId", "productName" """,
    )


ORACLES: dict[str, str] = {
    "daily_sales": _sales('"orderDate"', "orderDate"),
    "weekly_sales": _sales("CAST(date_trunc('week', \"orderDate\") AS date)", "weekStart"),
    "monthly_sales": _sales("CAST(date_trunc('month', \"orderDate\") AS date)", "monthStart"),
    "sales_of_all_grains": _all_grains(),
    "fact_order_lines": _with(*MODEL, FACT, select="SELECT * FROM fact"),
    "reconcile_revenue": _with(
        REGIONS, PRODUCTS, ORDERS, DETAILS, FACT,
        """totals AS (
            SELECT "orderDate", "regionId", "productId",
                   sum(CAST("lineRevenue" AS decimal(28, 2))) AS "totalRevenue"
            FROM fact GROUP BY ALL)""",
        select=RECONCILED.format(details="lineitem"),
    ),
    "line_revenue": _with(
        DETAILS, select='SELECT *, "quantity" * "unitPrice" AS "lineRevenue" FROM details'
    ),
    "event_date": 'SELECT event_id, CAST(ts AS date) AS "eventDate" FROM events',
    "join_lines_orders": _with(
        ORDERS, DETAILS, select='SELECT * FROM details JOIN model_orders USING ("orderId")'
    ),
    "join_lines_product": _with(
        PRODUCTS, DETAILS,
        select="""SELECT d.*, p."productName", p."category", p."unitPrice" AS "catalogUnitPrice"
        FROM details d JOIN products p ON p."productId" = d."productId" """,
    ),
    "join_orders_region": _with(
        REGIONS, ORDERS, select='SELECT * FROM model_orders JOIN regions USING ("regionId")'
    ),
    "drop_orphans": _with(
        DETAILS, SOME_PRODUCTS,
        select="""SELECT * FROM details d WHERE EXISTS (
            SELECT 1 FROM some_products p WHERE p."productId" = d."productId")""",
    ),
    "missing_references": _with(
        DETAILS, SOME_PRODUCTS,
        select="""SELECT count(*) AS "missing" FROM details d WHERE NOT EXISTS (
            SELECT 1 FROM some_products p WHERE p."productId" = d."productId")""",
    ),
    "drop_orphans_two_fk": _with(
        DETAILS, SOME_PRODUCTS,
        select="""SELECT * FROM details d
        WHERE EXISTS (SELECT 1 FROM orders o
                      WHERE o.o_orderkey = d."orderId" AND o.o_orderstatus <> 'P')
          AND EXISTS (SELECT 1 FROM some_products p WHERE p."productId" = d."productId")""",
    ),
    "drop_orphans_screened": _with(
        DETAILS,
        select="""SELECT * FROM details d WHERE EXISTS (
            SELECT 1 FROM orders o WHERE o.o_orderkey = d."orderId" AND o.o_orderstatus = 'P'
            AND o.o_orderdate < TIMESTAMP '1996-01-01')""",
    ),
    "missing_references_screened": _with(
        DETAILS,
        select="""SELECT count(*) AS "missing" FROM details d WHERE NOT EXISTS (
            SELECT 1 FROM orders o WHERE o.o_orderkey = d."orderId" AND o.o_orderstatus = 'P'
            AND o.o_orderdate < TIMESTAMP '1996-01-01')""",
    ),
    "dedupe_by_key": """SELECT * FROM lineitem QUALIFY row_number() OVER (
        PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_partkey NULLS FIRST, l_suppkey NULLS FIRST, l_quantity NULLS FIRST,
                 l_extendedprice NULLS FIRST, l_discount NULLS FIRST, l_tax NULLS FIRST,
                 l_returnflag NULLS FIRST, l_linestatus NULLS FIRST,
                 l_shipdate NULLS FIRST) = 1""",
    "count_duplicate_keys": """SELECT count(*) AS "duplicateKeys" FROM (
        SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""",
    "count_null_keys": """SELECT count(*) AS "nullKeys" FROM customer
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')""",
    "non_empty_gate": """
        SELECT 'region' AS "entity", count(*) > 0 AS "nonEmpty" FROM region
        UNION ALL SELECT 'product', count(*) > 0 FROM part
        UNION ALL SELECT 'order', count(*) > 0 FROM orders
        UNION ALL SELECT 'order_details', count(*) > 0 FROM lineitem
        UNION ALL SELECT 'large_product', count(*) > 0 FROM part WHERE p_size > 1000""",
    "rejected_rows": REJECTED,
    "reject_sample": f'{REJECTED} ORDER BY "orderDetailId" LIMIT 20',
    "reject_sample_text": f"""SELECT 'orderDetailId=' || "orderDetailId" || ' order=' || "orderId"
        || ' product=' || "productId" AS "reject"
        FROM ({REJECTED} ORDER BY "orderDetailId" LIMIT 20)""",
    "rows_not_in": """SELECT nullif(l_returnflag, 'A') AS "returnFlag",
            l_linestatus AS "lineStatus", l_linenumber AS "lineNumber"
        FROM lineitem a
        WHERE NOT EXISTS (
            SELECT 1 FROM lineitem b
            WHERE b.l_linenumber > 2
              AND nullif(a.l_returnflag, 'A') IS NOT DISTINCT FROM nullif(b.l_returnflag, 'A')
              AND a.l_linestatus IS NOT DISTINCT FROM b.l_linestatus
              AND a.l_linenumber IS NOT DISTINCT FROM b.l_linenumber)""",
    "distinct_keys": 'SELECT DISTINCT l_partkey AS "productId" FROM lineitem',
    "surrogate_ordinals": """SELECT o_custkey, row_number() OVER (ORDER BY o_custkey) - 1 AS ordinal
        FROM (SELECT DISTINCT o_custkey FROM orders)""",
    "order_region_map": _with(
        ORDERS,
        select="""SELECT "orderId", "regionId" FROM model_orders QUALIFY row_number() OVER (
            PARTITION BY "orderId"
            ORDER BY "orderTs" NULLS FIRST, "regionId" NULLS FIRST, "customerId" NULLS FIRST,
                     "status" NULLS FIRST) = 1""",
    ),
    "order_region_map_size": _with(
        ORDERS, select='SELECT count(DISTINCT "orderId") AS "mappings" FROM model_orders'
    ),
    "marked_up_prices": _with(
        PRODUCTS,
        select="""SELECT "productId", "unitPrice" * CAST(1.1 AS double) AS "markedUpPrice"
        FROM products""",
    ),
    "marked_up_prices_sample": _with(
        PRODUCTS,
        select="""SELECT "productId", "unitPrice" * CAST(1.1 AS double) AS "markedUpPrice"
        FROM products ORDER BY "productId" LIMIT 3""",
    ),
    "coerce_schema": _with(FOREIGN_PRODUCTS, select="SELECT * FROM coerced"),
    "drop_null_required": _with(
        FOREIGN_PRODUCTS,
        select="""SELECT * FROM coerced
        WHERE "productId" IS NOT NULL AND "unitPrice" IS NOT NULL""",
    ),
    "null_required_count": _with(
        FOREIGN_PRODUCTS,
        select="""SELECT count(*) AS "inputRows",
            count(*) FILTER ("productId" IS NULL OR "unitPrice" IS NULL) AS "droppedRows"
        FROM coerced""",
    ),
    "type_order_ts": _with(
        ORDERS, FAULTY_ORDERS,
        select="""SELECT "orderId", TRY_CAST("orderTs" AS timestamp) AS "orderTs"
        FROM faulty_orders""",
    ),
    "type_order_ts_zoned": _with(
        ORDERS, FAULTY_ORDERS,
        select="""SELECT "orderId",
            strftime(TRY_CAST("orderTs" AS timestamp), '%Y-%m-%d %H:%M:%S') AS "orderTs"
        FROM faulty_orders""",
    ),
    "event_date_zoned": 'SELECT event_id, CAST(ts AS date) AS "eventDate" FROM events',
    "typed_scan": """SELECT l_orderkey, CAST(l_linenumber AS bigint) AS l_linenumber, l_quantity
        FROM lineitem""",
    "ingest_quantity_total": """SELECT CAST(sum(CAST(l_quantity AS bigint)) AS bigint)
            AS "totalQuantity", count(*) AS "rows" FROM lineitem""",
    "ingest_text_lines": _with(
        DETAILS,
        select="""SELECT concat_ws(',', "orderDetailId", "orderId", "productId", "quantity",
            "unitPrice") AS "value" FROM details""",
    ),
    "ingest_region": """SELECT CAST(r_regionkey AS bigint) AS "regionId", r_name AS "regionName"
        FROM region""",
    "ingest_product": _with(PRODUCTS, select="SELECT * FROM products"),
    "ingest_orders": _with(
        ORDERS,
        select="""SELECT "orderId", CAST("orderTs" AS varchar) AS "orderTs",
            CAST("regionId" AS bigint) AS "regionId", "customerId", "status"
        FROM model_orders""",
    ),
    "ingest_order_details": _with(DETAILS, select="SELECT * FROM details"),
    "write_readback": "SELECT * FROM orders",
    "write_count": """SELECT count(*) AS "reportedRows", count(*) AS "writtenRows"
        FROM lineitem""",
    "refreshed_sales": _sales(
        '"orderDate"', "orderDate", "\"regionName\" <> 'ASIA' OR \"orderDate\" >= DATE '1998-04-01'"
    ),
    "silver_orders": _with(
        REGIONS, ORDERS, FAULTY_ORDERS, CLEAN_ORDERS, select="SELECT * FROM clean_orders"
    ),
    "silver_order_details": _with(
        *SILVER,
        select="""SELECT "orderDetailId", "orderId", "productId", "quantity", "unitPrice"
        FROM judged WHERE "missingParent" IS NULL""",
    ),
    "silver_rejects": _with(
        *SILVER, select='SELECT * FROM judged WHERE "missingParent" IS NOT NULL'
    ),
    "silver_report": _with(
        *SILVER,
        select="""
        SELECT 'region' AS "entity", count(*) AS "inputRows", count(*) AS "dedupedRows",
               CAST(0 AS bigint) AS "orphanRows", count(*) AS "keptRows"
        FROM region WHERE r_name <> 'ASIA'
        UNION ALL
        SELECT 'product', count(*), count(*), 0, count(*) FROM some_products
        UNION ALL
        SELECT 'order', (SELECT count(*) FROM faulty_orders),
               (SELECT count(DISTINCT "orderId") FROM faulty_orders),
               (SELECT count(DISTINCT "orderId") FROM faulty_orders)
                   - (SELECT count(*) FROM clean_orders),
               (SELECT count(*) FROM clean_orders)
        UNION ALL
        SELECT 'order_details', (SELECT count(*) FROM lineitem), count(*),
               count("missingParent"), count(*) - count("missingParent")
        FROM judged""",
    ),
    "pipeline_report": _with(
        *SILVER,
        select="""
        SELECT 'region' AS "entity", count(*) AS "inputRows", count(*) AS "dedupedRows",
               CAST(0 AS bigint) AS "orphanRows", count(*) AS "keptRows"
        FROM region WHERE r_name <> 'ASIA'
        UNION ALL
        SELECT 'product', count(*), count(*), 0, count(*) FROM some_products
        UNION ALL
        SELECT 'order', (SELECT count(*) FROM faulty_orders),
               (SELECT count(DISTINCT "orderId") FROM faulty_orders),
               (SELECT count(DISTINCT "orderId") FROM faulty_orders)
                   - (SELECT count(*) FROM clean_orders),
               (SELECT count(*) FROM clean_orders)
        UNION ALL
        SELECT 'order_details', (SELECT count(*) FROM lineitem), count(*),
               count("missingParent"), count(*) - count("missingParent")
        FROM judged""",
    ),
    "pipeline_rejects": _with(
        *SILVER, select='SELECT * FROM judged WHERE "missingParent" IS NOT NULL'
    ),
    "pipeline_fact": _with(PRODUCTS, *SILVER, JOB_FACT, select="SELECT * FROM fact"),
    "pipeline_daily_sales": _with(
        PRODUCTS, *SILVER, JOB_FACT, JOB_TOTALS,
        select='SELECT * REPLACE (CAST("totalRevenue" AS double) AS "totalRevenue") FROM totals',
    ),
    "pipeline_reconcile": _with(
        PRODUCTS, *SILVER, JOB_FACT, JOB_TOTALS,
        select=RECONCILED.format(details="""judged WHERE "missingParent" IS NULL"""),
    ),
}
