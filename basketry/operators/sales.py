"""Sales, geography, traffic and event tables, headline figures and report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.ordering import medians
from basketry.functions.scalars import AGE_BINS, attach_row, total
from basketry.session import stage


def _measures() -> dict:
    return {
        "revenue": total(F.col("line_revenue")),
        "profit": total(F.col("line_profit")),
        "orders_cnt": F.countDistinct("order_id"),
        "users_cnt": F.countDistinct("user_id"),
        "items_cnt": total(F.col("num_of_item")),
        "returned_items": F.sum("is_returned"),
        "return_rate": F.avg("is_returned"),
        "avg_price": F.avg("sale_price"),
        "avg_delivery_days": F.avg("delivery_days"),
        "avg_order_value": F.avg("line_revenue"),
    }


def sales_by(sales: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The named measures for every combination of non-missing keys."""
    for key in keys:
        sales = sales.where(F.col(key).isNotNull())
    named = _measures()
    return sales.groupBy(*keys).agg(*[named[m].alias(m) for m in measures])


def daily_sales(sales: DataFrame) -> DataFrame:
    return sales_by(sales, ["order_date"], ["revenue", "profit", "orders_cnt", "users_cnt", "items_cnt"])


def monthly_sales(sales: DataFrame) -> DataFrame:
    return sales_by(sales, ["order_month"], ["revenue", "profit", "orders_cnt", "users_cnt"])


def weekday_sales(sales: DataFrame) -> DataFrame:
    """Sales by weekday, Monday first (``day_index`` 0)."""
    with_index = sales.withColumn("day_index", F.weekday("created_at"))
    return sales_by(with_index, ["day_index", "day_of_week"], ["revenue", "orders_cnt"]).orderBy("day_index")


def category_revenue(sales: DataFrame, top: int | None = None) -> DataFrame:
    """Categories by revenue, biggest first."""
    out = sales_by(sales, ["category"], ["revenue", "profit", "orders_cnt", "return_rate", "avg_price"])
    out = out.orderBy(F.desc("revenue"), "category")
    return out.limit(top) if top is not None else out


def top_products(sales: DataFrame, top: int = 15) -> DataFrame:
    """Products with the most revenue."""
    out = sales_by(sales, ["product_id", "product_name"], ["revenue", "profit", "orders_cnt", "return_rate"])
    return out.orderBy(F.desc("revenue"), "product_id").limit(top)


def category_returns(sales: DataFrame, min_orders: int = 30) -> DataFrame:
    """Categories by return rate, those with few orders left out."""
    out = sales_by(sales, ["category"], ["orders_cnt", "returned_items", "return_rate", "avg_delivery_days", "revenue"])
    return out.where(F.col("orders_cnt") >= min_orders).orderBy(F.desc("return_rate"), "category")


def logistics_summary(sales: DataFrame) -> DataFrame:
    """Mean and exact median of the four durations, one row each."""
    columns = ["shipping_delay_days", "delivery_days", "delivery_gap_days", "return_days"]
    means = sales.agg(*[F.avg(c).alias(f"{c}_mean") for c in columns])
    row = attach_row(means, medians(sales, columns))
    pairs = [
        F.struct(F.lit(c).alias("duration"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_median").alias("median")) for c in columns
    ]
    return row.select(F.inline(F.array(*pairs)))


def geo_sales(sales: DataFrame, top: int | None = None) -> DataFrame:
    """State and city by revenue."""
    out = sales_by(sales, ["state", "city"], ["revenue", "profit", "users_cnt", "orders_cnt", "avg_delivery_days"])
    out = out.orderBy(F.desc("revenue"), "state", "city")
    return out.limit(top) if top is not None else out


def state_sales(sales: DataFrame) -> DataFrame:
    return sales_by(sales, ["state"], ["revenue", "users_cnt", "avg_delivery_days"]).orderBy(F.desc("revenue"), "state")


def traffic_sales(sales: DataFrame) -> DataFrame:
    out = sales_by(sales, ["traffic_source"], ["revenue", "users_cnt", "orders_cnt", "avg_order_value"])
    return out.orderBy(F.desc("revenue"), "traffic_source")


def gender_sales(sales: DataFrame) -> DataFrame:
    return sales_by(sales, ["gender"], ["revenue", "users_cnt", "avg_order_value"])


def age_sales(sales: DataFrame) -> DataFrame:
    """Sales by age group; every group appears, an empty one with zero sums."""
    labels = sales.sparkSession.range(1).select(F.explode(F.array(*[F.lit(b[2]) for b in AGE_BINS])).alias("age_group"))
    found = sales_by(sales, ["age_group"], ["revenue", "users_cnt", "avg_order_value"])
    return labels.join(found, "age_group", "left").select(
        "age_group",
        F.coalesce("revenue", F.lit(0.0)).alias("revenue"),
        F.coalesce("users_cnt", F.lit(0)).alias("users_cnt"),
        "avg_order_value",
    )


def events_by(events: DataFrame, key: str, sessions: bool = False) -> DataFrame:
    """Events and users (and sessions) by day, type or browser; undated events are left out."""
    dated = events.where(F.col("created_at").isNotNull()).withColumn("event_date", F.to_date("created_at"))
    measures = [F.count("id").alias("events_cnt"), F.countDistinct("user_id").alias("users_cnt")]
    if sessions:
        measures.append(F.countDistinct("session_id").alias("sessions_cnt"))
    out = dated.where(F.col(key).isNotNull()).groupBy(key).agg(*measures)
    return out.orderBy(key) if key == "event_date" else out.orderBy(F.desc("events_cnt"), key)


def headline_figures(lines: DataFrame, predictions: DataFrame) -> DataFrame:
    """Revenue, orders, customers and the share of high-risk customers."""
    figures = lines.agg(
        total(F.col("sale_price")).alias("revenue"),
        F.countDistinct("order_id").alias("orders"),
        F.countDistinct("user_id").alias("customers"),
    )
    share = predictions.agg(F.avg((F.col("risk_group") == "high").cast("int")).alias("high_risk_share"))
    return attach_row(figures, share)


def frequency(df: DataFrame, column: str, name: str = "count", top: int | None = None) -> DataFrame:
    """Frequency of every non-missing value, most frequent first."""
    out = (
        df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), column)
    )
    return out.limit(top) if top is not None else out


def riskiest_customers(predictions: DataFrame, top: int = 10) -> DataFrame:
    return predictions.orderBy(F.desc("churn_probability"), "user_id").limit(top)


def sold_days(lines: DataFrame, keys: Sequence[str] = (), item: str = "order_id") -> DataFrame:
    """Items, orders and revenue of every day with sales, cancelled lines left out."""
    kept = lines.where((F.coalesce(F.col("status"), F.lit("")) != "Cancelled") & F.col("created_at").isNotNull())
    for key in keys:
        kept = kept.where(F.col(key).isNotNull())
    return kept.groupBy(*keys, F.to_date("created_at").alias("date")).agg(
        F.count(item).alias("items"), F.countDistinct("order_id").alias("orders"), total(F.col("sale_price")).alias("revenue")
    )


def full_calendar(daily: DataFrame, keys: Sequence[str] = (), measures: Sequence[str] = ("items", "orders", "revenue")) -> DataFrame:
    """Fill the days between the first and the last with zeros (for every series by ``keys``)."""
    daily = stage(daily, "daily")
    span = daily.groupBy(*keys).agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    spine = span.where(F.col("_from").isNotNull()).select(
        *keys, F.explode(F.sequence("_from", "_to", F.expr("INTERVAL 1 DAY"))).alias("date")
    )
    return spine.join(daily, [*keys, "date"], "left").na.fill(0, list(measures))


def resample(daily: DataFrame, period: str, keys: Sequence[str] = (), measures: Sequence[str] = ("items", "orders", "revenue")) -> DataFrame:
    """Sum a daily series by month start or by week ending on Sunday."""
    date = F.trunc("date", "month") if period == "month" else F.date_add(F.date_trunc("week", "date").cast("date"), 6)
    return daily.groupBy(*keys, date.alias("date")).agg(*[F.sum(m).alias(m) for m in measures])


def seasonality(monthly: DataFrame, measure: str = "items") -> DataFrame:
    """Year x month table of a monthly measure."""
    with_month = monthly.withColumn("_month", F.month("date"))
    return with_month.groupBy(F.year("date").alias("year")).pivot("_month", list(range(1, 13))).agg(F.sum(measure))
