"""Sales, geography, event and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions.scalars import age_group, risk_band
from basketry.operators import sales as sa
from basketry.plans.catalog import query, view
from basketry.plans.customers_queries import customer_features, customer_profile, sales
from basketry.sources.tables import event_log, order_items


def _sales_query(name, spec, sql, fn, *columns):
    @query(name, spec, sql)
    def run(spark, d):
        return fn(sales(spark, d, *columns))

    return run


M = {
    "revenue": "sum(line_revenue) AS revenue",
    "profit": "sum(line_profit) AS profit",
    "orders_cnt": "count(DISTINCT order_id) AS orders_cnt",
    "users_cnt": "count(DISTINCT user_id) AS users_cnt",
    "items_cnt": "sum(num_of_item) AS items_cnt",
    "returned_items": "sum(is_returned) AS returned_items",
    "return_rate": "avg(is_returned) AS return_rate",
    "avg_price": "avg(sale_price) AS avg_price",
    "avg_delivery_days": "avg(delivery_days) AS avg_delivery_days",
    "avg_order_value": "avg(line_revenue) AS avg_order_value",
}
KIND = {"orders_cnt": "i", "users_cnt": "i", "items_cnt": "i", "returned_items": "i"}


def _sql(keys, measures, tail=""):
    return f"SELECT {keys}, " + ", ".join(M[m] for m in measures) + f" FROM sales GROUP BY ALL {tail}"


def _spec(keys, measures):
    return keys + " " + " ".join(f"{m}:{KIND.get(m, 'f')}" for m in measures)


_DAILY = ["revenue", "profit", "orders_cnt", "users_cnt", "items_cnt"]
_sales_query("e07_daily_sales", _spec("order_date:d", _DAILY), _sql("order_date", _DAILY), sa.daily_sales, "order_id", "user_id")
_MONTHLY = _DAILY[:4]
_sales_query("e08_monthly_sales", _spec("order_month:s", _MONTHLY), _sql("order_month", _MONTHLY), sa.monthly_sales, "order_id", "user_id")
_sales_query(
    "e09_weekday_sales",
    _spec("day_index:i day_of_week:s", ["revenue", "orders_cnt"]),
    _sql("isodow(created_at) - 1 AS day_index, dayname(created_at) AS day_of_week", ["revenue", "orders_cnt"]),
    sa.weekday_sales,
    "order_id",
)
_CATEGORY = ["revenue", "profit", "orders_cnt", "return_rate", "avg_price"]
_sales_query("e10_category_revenue", _spec("category:s", _CATEGORY), _sql("category", _CATEGORY), sa.category_revenue, "order_id", "category")
_PRODUCT = ["revenue", "profit", "orders_cnt", "return_rate"]
_sales_query(
    "e11_top_products",
    _spec("product_id:i product_name:s", _PRODUCT),
    _sql("product_id, product_name", _PRODUCT, "ORDER BY revenue DESC, product_id LIMIT 15"),
    sa.top_products,
    "order_id",
    "product_id",
    "product_name",
)
_RETURNS = ["orders_cnt", "returned_items", "return_rate", "avg_delivery_days", "revenue"]
_sales_query(
    "e12_category_returns",
    _spec("category:s", _RETURNS),
    _sql("category", _RETURNS, "HAVING count(DISTINCT order_id) >= 30"),
    sa.category_returns,
    "order_id",
    "category",
)
_sales_query(
    "e13_logistics_summary",
    "duration:s mean:f median:f",
    " UNION ALL ".join(
        f"SELECT '{c}' AS duration, avg({c}) AS mean, median({c}) AS median FROM sales"
        for c in ["shipping_delay_days", "delivery_days", "delivery_gap_days", "return_days"]
    ),
    sa.logistics_summary,
    "order_id",
)
_GEO = ["revenue", "profit", "users_cnt", "orders_cnt", "avg_delivery_days"]
_GEO_COLUMNS = ["order_id", "user_id", "state", "city"]
_sales_query("e14_geo_sales", _spec("state:s city:s", _GEO), _sql("state, city", _GEO), sa.geo_sales, *_GEO_COLUMNS)
_sales_query(
    "e14_geo_top",
    _spec("state:s city:s", _GEO),
    _sql("state, city", _GEO, "ORDER BY revenue DESC, state, city LIMIT 20"),
    lambda s: sa.geo_sales(s, 20),
    *_GEO_COLUMNS,
)
_STATE = ["revenue", "users_cnt", "avg_delivery_days"]
_sales_query("e14_state_sales", _spec("state:s", _STATE), _sql("state", _STATE), sa.state_sales, "user_id", "state")
_TRAFFIC = ["revenue", "users_cnt", "orders_cnt", "avg_order_value"]
_sales_query(
    "e15_traffic_sales", _spec("traffic_source:s", _TRAFFIC), _sql("traffic_source", _TRAFFIC), sa.traffic_sales,
    "order_id", "user_id", "traffic_source",
)
_GENDER = ["revenue", "users_cnt", "avg_order_value"]
_sales_query("e15_gender_sales", _spec("gender:s", _GENDER), _sql("gender", _GENDER), sa.gender_sales, "user_id", "gender")


@query(
    "e16_age_sales",
    _spec("age_group:s", _GENDER),
    """
SELECT g.age_group, coalesce(sum(line_revenue), 0) AS revenue, count(DISTINCT user_id) AS users_cnt, avg(line_revenue) AS avg_order_value
FROM (VALUES (14, 24, '14-24'), (24, 34, '25-34'), (34, 44, '35-44'), (44, 54, '45-54'), (54, 64, '55-64'), (64, 100, '65+')) g(lo, hi, age_group)
LEFT JOIN sales s ON s.age > g.lo AND s.age <= g.hi GROUP BY g.age_group
""",
)
def e16(spark, d):
    return sa.age_sales(sales(spark, d, "user_id", "age").withColumn("age_group", age_group(F.col("age"))))


for _key, _column, _sessions in [("day", "event_date", True), ("type", "event_type", False), ("browser", "browser", False)]:

    def _register(key, column, sessions):
        kind = "d" if column == "event_date" else "s"
        source = "CAST(created_at AS DATE) AS event_date" if column == "event_date" else column
        extra = ", count(DISTINCT session_id) AS sessions_cnt" if sessions else ""

        @query(
            f"e17_events_by_{key}",
            f"{column}:{kind} events_cnt:i users_cnt:i" + (" sessions_cnt:i" if sessions else ""),
            f"SELECT {source}, count(id) AS events_cnt, count(DISTINCT user_id) AS users_cnt{extra} FROM event_log GROUP BY ALL",
        )
        def run(spark, d):
            return sa.events_by(event_log(spark, d), column, sessions)

    _register(_key, _column, _sessions)


DAY_INPUTS = ["order_id", "status", "created_at", "sale_price"]

view(
    "sold_days",
    "SELECT CAST(created_at AS DATE) AS date, count(order_id) AS items, count(DISTINCT order_id) AS orders, sum(sale_price) AS revenue "
    "FROM order_items WHERE status <> 'Cancelled' GROUP BY ALL",
)
view(
    "full_days",
    "SELECT CAST(s.date AS DATE) AS date, coalesce(items, 0) AS items, coalesce(orders, 0) AS orders, coalesce(revenue, 0) AS revenue "
    "FROM (SELECT unnest(generate_series((SELECT min(date) FROM sold_days)::TIMESTAMP, (SELECT max(date) FROM sold_days)::TIMESTAMP, "
    "INTERVAL 1 DAY)) AS date) s LEFT JOIN sold_days x ON x.date = CAST(s.date AS DATE)",
)
view(
    "month_series",
    "SELECT CAST(date_trunc('month', date) AS DATE) AS date, sum(items) AS items, sum(orders) AS orders, sum(revenue) AS revenue FROM full_days GROUP BY 1",
)
view(
    "week_series",
    "SELECT CAST(date_trunc('week', date) AS DATE) + 6 AS date, sum(items) AS items, sum(orders) AS orders, sum(revenue) AS revenue "
    "FROM full_days GROUP BY 1",
)
SERIES_SPEC = "date:d items:i orders:i revenue:f"


def full_days(spark, d, keys=()):
    return sa.full_calendar(sa.sold_days(order_items(spark, d, *keys, *DAY_INPUTS), keys), keys)


@query("e28_full_calendar", SERIES_SPEC, "SELECT * FROM full_days")
def e28(spark, d):
    return full_days(spark, d)


@query("e29_monthly_series", SERIES_SPEC, "SELECT * FROM month_series")
def e29_month(spark, d):
    return sa.resample(full_days(spark, d), "month")


@query("e29_weekly_series", SERIES_SPEC, "SELECT * FROM week_series")
def e29_week(spark, d):
    return sa.resample(full_days(spark, d), "week")


@query(
    "e30_seasonality",
    "year:i " + " ".join(f"m{m}:i" for m in range(1, 13)),
    "SELECT year(date) AS year, " + ", ".join(f"sum(items) FILTER (month(date) = {m}) AS m{m}" for m in range(1, 13)) + " FROM month_series GROUP BY 1",
)
def e30(spark, d):
    table = sa.seasonality(sa.resample(full_days(spark, d), "month"))
    return table.select("year", *[F.col(f"`{m}`").alias(f"m{m}") for m in range(1, 13)])


# Scores of the registered report queries: a fixed rule on recency stands in for a model, so SQL can repeat it.
view(
    "fixture_predictions",
    "SELECT user_id, p AS churn_probability, CASE WHEN p <= 0.35 THEN 'low' WHEN p <= 0.65 THEN 'medium' ELSE 'high' END AS risk_group "
    "FROM (SELECT user_id, round(recency_days / (recency_days + 180), 9) AS p FROM customer_base)",
)


def fixture_predictions(customers):
    p = F.round(F.col("recency_days") / (F.col("recency_days") + 180), 9)
    return customers.select("user_id", p.alias("churn_probability")).withColumn("risk_group", risk_band(F.col("churn_probability")))


@query(
    "e32_headline_figures",
    "revenue:f orders:i customers:i high_risk_share:f",
    "SELECT sum(sale_price) AS revenue, count(DISTINCT order_id) AS orders, count(DISTINCT user_id) AS customers, "
    "(SELECT avg(CAST(risk_group = 'high' AS INTEGER)) FROM fixture_predictions) AS high_risk_share FROM order_items",
)
def e32(spark, d):
    lines = order_items(spark, d, "order_id", "user_id", "sale_price")
    return sa.headline_figures(lines, fixture_predictions(customer_features(spark, d)))


@query(
    "e33_risk_group_counts",
    "risk_group:s customers:i",
    "SELECT risk_group, count(*) AS customers FROM fixture_predictions GROUP BY risk_group",
)
def e33_groups(spark, d):
    return sa.frequency(fixture_predictions(customer_features(spark, d)), "risk_group", "customers")


@query(
    "e33_riskiest_customers",
    "user_id:i churn_probability:f risk_group:s",
    "SELECT * FROM fixture_predictions ORDER BY churn_probability DESC, user_id LIMIT 10",
)
def e33_riskiest(spark, d):
    return sa.riskiest_customers(fixture_predictions(customer_features(spark, d)))


@query(
    "e33_top_segments",
    "customer_segment:s customers:i",
    "SELECT customer_segment, count(*) AS customers FROM customer_profile GROUP BY 1 ORDER BY customers DESC, customer_segment LIMIT 10",
)
def e33_segments(spark, d):
    return sa.frequency(customer_profile(spark, d), "customer_segment", "customers", 10)
