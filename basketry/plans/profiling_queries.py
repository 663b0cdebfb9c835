"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import profiling as pf
from basketry.operators.sales import frequency
from basketry.plans.catalog import query, view
from basketry.plans.customers_queries import customer_features, sales
from basketry.sources.tables import ORDER_ITEM_COLUMNS, order_items

view(
    "missing_rows",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing_cnt, count(*) AS n FROM order_items" for c in ORDER_ITEM_COLUMNS
    ),
)

_DTYPES = {
    **{c: "bigint" for c in ["order_id", "user_id", "product_id", "distribution_center_id"]},
    **{c: "timestamp" for c in ["created_at", "shipped_at", "delivered_at", "returned_at"]},
    **{c: "double" for c in ["retail_price", "sale_price", "cost", "age"]},
    "num_of_item": "int",
    "is_loyal": "boolean",
}
_CASES = " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in _DTYPES.items())


@query(
    "c01_table_overview",
    "table:s rows:i columns:i duplicate_rows:i column:s dtype:s missing_pct:f",
    f"SELECT 'order_items' AS \"table\", n AS rows, {len(ORDER_ITEM_COLUMNS)} AS columns, "
    "(SELECT count(*) FROM order_items) - (SELECT count(*) FROM (SELECT DISTINCT * FROM order_items)) AS duplicate_rows, "
    f"\"column\", CASE \"column\" {_CASES} ELSE 'string' END AS dtype, round(missing_cnt * 100.0 / n, 2) AS missing_pct "
    "FROM (SELECT * FROM missing_rows ORDER BY missing_cnt DESC, \"column\" LIMIT 20)",
)
def c01(spark, d):
    return pf.table_overview(order_items(spark, d), "order_items")


@query(
    "c02_missing_report",
    "column:s missing_cnt:i missing_pct:f",
    "SELECT \"column\", missing_cnt, missing_cnt * 100.0 / n AS missing_pct FROM missing_rows",
)
def c02(spark, d):
    return pf.missing_report(order_items(spark, d))


_NUMBERS = ["sale_price", "cost", "num_of_item", "age", "delivery_days", "return_days"]


@query(
    "c03_describe_numbers",
    "column:s count:i mean:f std:f min:f p1:f p5:f p50:f p95:f p99:f max:f",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS \"count\", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, "
        + ", ".join(f"quantile_cont({c}, {q}) AS {n}" for q, n in [(0.01, "p1"), (0.05, "p5"), (0.5, "p50"), (0.95, "p95"), (0.99, "p99")])
        + f", max({c}) AS max FROM sales"
        for c in _NUMBERS
    ),
)
def c03(spark, d):
    return pf.describe_numbers(sales(spark, d, "age"), _NUMBERS)


# Mixed time texts made from every order date: four writable forms, one that cannot parse, one missing.
view(
    "time_texts",
    """
SELECT order_id, product_id, CASE (order_id + product_id) % 6 WHEN 0 THEN strftime(created_at, '%Y-%m-%d %H:%M:%S')
  WHEN 1 THEN strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(created_at, '%Y-%m-%d %H:%M:%S+00:00')
  WHEN 3 THEN strftime(created_at, '%Y-%m-%d %H:%M:%S UTC') WHEN 4 THEN 'bad ' || strftime(created_at, '%Y') END AS created_text,
  (order_id + product_id) % 6 AS form, created_at FROM order_items
""",
)


def time_texts(spark, d):
    lines = order_items(spark, d, "order_id", "product_id", "created_at")
    form = (F.col("order_id") + F.col("product_id")) % 6
    t = F.col("created_at")
    text = (
        F.when(form == 0, F.date_format(t, "yyyy-MM-dd HH:mm:ss"))
        .when(form == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(form == 2, F.date_format(t, "yyyy-MM-dd HH:mm:ss'+00:00'"))
        .when(form == 3, F.date_format(t, "yyyy-MM-dd HH:mm:ss' UTC'"))
        .when(form == 4, F.concat(F.lit("bad "), F.date_format(t, "yyyy")))
    )
    return lines.withColumn("created_text", text)


@query(
    "c04_parse_audit",
    "column:s raw_non_null:i parsed_non_null:i failed:i samples:s",
    "SELECT 'created_text' AS \"column\", count(created_text) AS raw_non_null, count(*) FILTER (form < 4) AS parsed_non_null, "
    "count(*) FILTER (form = 4) AS failed, (SELECT string_agg(t, ',' ORDER BY t) FROM (SELECT DISTINCT created_text AS t FROM time_texts "
    "WHERE form = 4 ORDER BY t LIMIT 20)) AS samples FROM time_texts",
)
def c04(spark, d):
    return pf.parse_audit(time_texts(spark, d), ["created_text"]).withColumn("samples", F.array_join("samples", ","))


@query(
    "c05_frequency",
    "city:s count:i",
    "SELECT city, count(*) AS \"count\" FROM order_items GROUP BY city ORDER BY \"count\" DESC, city LIMIT 25",
)
def c05(spark, d):
    return frequency(order_items(spark, d, "city"), "city", top=25)


_BOX = ["sale_price", "cost", "retail_price", "age", "delivery_days"]


@query(
    "c06_box_statistics",
    "column:s q1:f median:f q3:f whisker_low:f whisker_high:f outliers:i",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", any_value(q1) AS q1, any_value(q2) AS median, any_value(q3) AS q3, "
        f"min({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low, "
        f"max({c}) FILTER ({c} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high, "
        f"count(*) FILTER ({c} NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM sales, "
        f"(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3 FROM sales)"
        for c in _BOX
    ),
)
def c06(spark, d):
    return pf.box_statistics(sales(spark, d, "age"), _BOX)


@query(
    "c07_histogram",
    "bin:i low:f high:f count:i",
    """
WITH v AS (SELECT delivery_days AS v FROM sales WHERE delivery_days IS NOT NULL), s AS (SELECT min(v) AS lo, max(v) AS hi FROM v),
  b AS (SELECT CAST(least(floor((v - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS bin, count(*) AS n FROM v, s GROUP BY 1)
SELECT g.bin, lo + g.bin * ((hi - lo) / 40) AS low, lo + (g.bin + 1) * ((hi - lo) / 40) AS high, coalesce(n, 0) AS "count"
FROM s, (SELECT unnest(range(40)) AS bin) g LEFT JOIN b ON b.bin = g.bin
""",
)
def c07(spark, d):
    return pf.histogram(sales(spark, d, "order_id"), "delivery_days")


@query(
    "c08_fixed_sample",
    "user_id:i recency_days:i total_spend:f",
    "SELECT user_id, recency_days, total_spend FROM customer_profile ORDER BY md5(user_id || ':42'), user_id LIMIT 5000",
)
def c08(spark, d):
    return pf.fixed_sample(customer_features(spark, d), "user_id")
