"""Customer-level features from order lines and events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.grouping import with_value_profile
from basketry.functions.scalars import attach_row, clip, safe_ratio, total, whole_days
from basketry.session import stage

# Event types behind the five named roles of the event features.
EVENT_ROLES = {
    "cart": "cart",
    "purchase": "purchase",
    "cancel": "cancel",
    "product": "product",
    "department": "department",
}


def latest_order_lines(lines: DataFrame) -> DataFrame:
    """One row for each (order, user): its newest line, an undated line counting as newest.

    A struct max rather than a window, so it combines map-side and a huge order is no
    problem; flags break ties.
    """
    newest = F.max(F.struct(F.col("created_at").isNull(), "created_at", "is_cancelled", "is_completed")).alias("newest")
    return (
        lines.where(F.col("user_id").isNotNull() & F.col("order_id").isNotNull())
        .groupBy("user_id", "order_id")
        .agg(newest)
        .select("user_id", "order_id", "newest.created_at", "newest.is_cancelled", "newest.is_completed")
    )


def customer_features(lines: DataFrame) -> DataFrame:
    """Spend, variety, service and order-count features of every customer.

    Lines are read twice: summed by (user, order), from which the totals, the orders and the newest time follow, and
    counted by value for distinct values, modes and the median age.
    """
    means = {"avg_item_price": "sale_price", "avg_shipping_days": "shipping_days", "avg_delivery_days": "delivery_days"}
    newest = F.max(F.struct(F.col("created_at").isNull(), "created_at", "is_cancelled", "is_completed"))
    orders = lines.groupBy("user_id", "order_id").agg(
        F.count(F.lit(1)).alias("items"),
        total(F.col("sale_price")).alias("total_spend"),
        total(F.col("margin")).alias("total_margin"),
        F.sum("is_returned").alias("returned_items"),
        F.sum("is_cancelled").alias("cancelled_items"),
        F.sum("is_completed").alias("completed_items"),
        F.sum("is_shipped").alias("shipped_items"),
        *[F.sum(c).alias(f"_sum_{c}") for c in means.values()],
        *[F.count(c).alias(f"_n_{c}") for c in means.values()],
        F.max("is_loyal").alias("is_loyal"),
        F.min("created_at").alias("first_order"),
        F.max("created_at").alias("last_order"),
        newest.alias("_newest"),
    )
    orders = stage(orders, "orders")
    known = orders.where(F.col("user_id").isNotNull())
    reference = orders.agg((F.max("last_order") + F.expr("INTERVAL 1 DAY")).alias("reference_date"))
    real = F.col("order_id").isNotNull()
    sums = ["items", "total_spend", "total_margin", "returned_items", "cancelled_items", "completed_items", "shipped_items"]
    customer = known.groupBy("user_id").agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.try_divide(F.sum(f"_sum_{c}"), F.sum(f"_n_{c}")).alias(name) for name, c in means.items()],
        F.max("is_loyal").alias("is_loyal"),
        F.min("first_order").alias("first_order"),
        F.max("last_order").alias("last_order"),
        F.count(F.when(real, 1)).alias("orders"),
        F.sum(F.when(real, F.col("_newest.is_cancelled"))).alias("cancelled_orders"),
        F.sum(F.when(real, F.col("_newest.is_completed"))).alias("completed_orders"),
    )
    customer = with_value_profile(
        customer,
        lines.where(F.col("user_id").isNotNull()),
        ["user_id"],
        distinct={"unique_products": "product_id", "unique_categories": "category"},
        modes={c: c for c in ["gender", "country", "city", "traffic_source"]},
        default="unknown",
        middles={"age": "age"},
    )
    order_columns = ["orders", "cancelled_orders", "completed_orders"]
    joined = attach_row(customer.withColumns({c: F.when(F.col("orders") > 0, F.col(c)) for c in order_columns}), reference)
    tenure = clip(whole_days(F.col("last_order"), F.col("first_order")), 0)
    return joined.select(
        *[c for c in customer.columns if c not in order_columns],
        *order_columns,
        safe_ratio(F.col("total_spend"), F.col("orders")).alias("avg_order_value"),
        safe_ratio(F.col("returned_items"), F.col("items")).alias("return_rate"),
        safe_ratio(F.col("cancelled_items"), F.col("items")).alias("cancel_rate"),
        safe_ratio(F.col("completed_items"), F.col("items")).alias("completion_rate"),
        whole_days(F.col("reference_date"), F.col("last_order")).alias("recency_days"),
        tenure.alias("tenure_days"),
        safe_ratio(F.col("orders"), tenure + 1).alias("purchase_frequency"),
    )


def event_features(events: DataFrame, roles: Mapping[str, str] = EVENT_ROLES) -> DataFrame:
    """Event counts, sessions and role counts of every known user."""
    kind = F.col("event_type")
    counts = events.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("event_count"),
        F.countDistinct("session_id").alias("sessions"),
        F.min("created_at").alias("first_event"),
        F.max("created_at").alias("last_event"),
        *[F.count_if(kind == value).alias(f"event_{role}") for role, value in roles.items()],
    )
    return counts.select(
        "*",
        safe_ratio(F.col("event_count"), F.col("sessions")).alias("events_per_session"),
        safe_ratio(F.col("event_purchase"), F.col("event_cart")).alias("cart_to_purchase_rate"),
        safe_ratio(F.col("event_cancel"), F.col("event_count")).alias("cancel_event_rate"),
    )


def join_event_features(customers: DataFrame, events: DataFrame) -> DataFrame:
    """Customers with their event features; missing numbers become 0, times stay NULL."""
    numbers = [f.name for f in events.schema.fields if f.name != "user_id" and f.dataType.typeName() != "timestamp"]
    return customers.join(events, "user_id", "left").na.fill(0, numbers)


def event_activity(events: DataFrame, event_types: Sequence[str]) -> DataFrame:
    """Per-user activity: volumes, favourites, a count for each listed type, days idle."""
    known = events.where(F.col("user_id").isNotNull())
    newest = known.agg(F.max("created_at").alias("newest_event"))
    per_user = known.groupBy("user_id").agg(
        F.count("id").alias("events_cnt"),
        F.max("created_at").alias("last_event_at"),
        *[
            F.count_if(F.col("event_type") == t).alias(f"event_type_{t.lower().replace(' ', '_')}_cnt")
            for t in event_types
        ],
    )
    per_user = with_value_profile(
        per_user,
        known.withColumn("event_date", F.to_date("created_at")),
        ["user_id"],
        distinct={"unique_sessions": "session_id", "active_days": "event_date"},
        modes={"favorite_browser": "browser", "favorite_event_type": "event_type"},
    )
    return attach_row(per_user, newest).select(
        *per_user.columns, whole_days(F.col("newest_event"), F.col("last_event_at")).alias("days_since_last_event")
    )


def favourite_share(lines: DataFrame, column: str = "category") -> DataFrame:
    """Share of a user's lines in their most bought category (two-level counts)."""
    counts = (
        lines.where(F.col("user_id").isNotNull() & F.col(column).isNotNull())
        .groupBy("user_id", column)
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    return counts.groupBy("user_id").agg((F.max("cnt") / F.sum("cnt")).alias("favorite_category_share"))


def user_review_features(reviews: DataFrame) -> DataFrame:
    """Review features of every user."""
    return reviews.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("review_text").alias("user_review_count"),
        F.avg("review_word_count").alias("user_avg_review_len"),
        F.avg("review_negative_flag").alias("user_negative_review_rate"),
        F.avg("review_positive_flag").alias("user_positive_review_rate"),
        F.avg("review_sentiment_score").alias("user_avg_sentiment_score"),
    )


def _profile_aggregates() -> dict:
    return {
        "first_order_at": F.min("created_at"),
        "last_order_at": F.max("created_at"),
        "items_cnt": total(F.col("num_of_item")),
        "total_revenue": total(F.col("line_revenue")),
        "total_profit": total(F.col("line_profit")),
        "avg_order_value": F.avg("line_revenue"),
        "avg_items_per_line": F.avg("num_of_item"),
        "avg_margin_ratio": F.avg("margin_ratio"),
        "return_rate": F.avg("is_returned"),
        "cancel_rate": F.avg("is_cancelled"),
        "avg_delivery_days": F.avg("delivery_days"),
        "avg_shipping_delay_days": F.avg("shipping_delay_days"),
        "discount_ratio_mean": F.avg("discount_ratio"),
        "age": F.median("age"),
        "is_loyal": F.max("is_loyal"),
    }


PROFILE_DISTINCT = {
    "orders_cnt": "order_id",
    "unique_categories": "category",
    "unique_products": "product_id",
    "unique_brands": "brand",
}
PROFILE_MODES = {
    "favorite_category": "category",
    "favorite_brand": "brand",
    "gender": "gender",
    "state": "state",
    "city": "city",
    "traffic_source": "traffic_source",
}


# Columns of the two published customer tables.
MART_COLUMNS = [
    "first_order_at", "last_order_at", "orders_cnt", "items_cnt", "total_revenue", "total_profit", "avg_order_value",
    "avg_items_per_line", "return_rate", "cancel_rate", "avg_delivery_days", "avg_shipping_delay_days",
    "discount_ratio_mean", "unique_categories", "unique_brands", "favorite_category", "favorite_brand", "age",
    "gender", "state", "city", "traffic_source", "is_loyal",
]
CLUSTER_COLUMNS = [
    "orders_cnt", "items_cnt", "total_revenue", "total_profit", "avg_order_value", "avg_margin_ratio", "return_rate",
    "avg_delivery_days", "avg_shipping_delay_days", "unique_categories", "unique_products", "unique_brands",
    "first_order_at", "last_order_at", "favorite_category", "favorite_brand", "traffic_source", "state", "gender",
    "age", "is_loyal",
]


def _user_table(sales: DataFrame, columns: Sequence[str], recency_name: str, frequency_name: str) -> DataFrame:
    aggregates = _profile_aggregates()
    known = sales.where(F.col("user_id").isNotNull())
    users = with_value_profile(
        known.groupBy("user_id").agg(*[aggregates[c].alias(c) for c in columns if c in aggregates]),
        known,
        ["user_id"],
        distinct={name: c for name, c in PROFILE_DISTINCT.items() if name in columns},
        modes={name: c for name, c in PROFILE_MODES.items() if name in columns},
    )
    snapshot = sales.agg((F.max("created_at") + F.expr("INTERVAL 1 DAY")).alias("snapshot_at"))
    tenure = whole_days(F.col("snapshot_at"), F.col("first_order_at"))
    return attach_row(users, snapshot).select(
        *users.columns,
        tenure.alias("customer_tenure_days"),
        whole_days(F.col("snapshot_at"), F.col("last_order_at")).alias(recency_name),
        (F.col("orders_cnt") / F.greatest(tenure / 30, F.lit(1.0))).alias(frequency_name),
    )


def customer_mart(sales: DataFrame, rfm: DataFrame, activity: DataFrame) -> DataFrame:
    """The published customer table: order features, favourite share, RFM and activity."""
    users = _user_table(sales, MART_COLUMNS, "days_since_last_order", "purchase_frequency_per_30d")
    rfm = rfm.select("user_id", "recency", "frequency", "monetary", "rfm_score", "rfm_segment")
    return (
        users.join(favourite_share(sales), "user_id", "left").join(rfm, "user_id", "left").join(activity, "user_id", "left")
    )


def cluster_mart(sales: DataFrame, events: DataFrame, review_features: DataFrame) -> DataFrame:
    """The table customers are clustered on."""
    users = _user_table(sales, CLUSTER_COLUMNS, "recency_days", "purchase_frequency_30d")
    snapshot = sales.agg((F.max("created_at") + F.expr("INTERVAL 1 DAY")).alias("snapshot_at"))
    activity = events.where(F.col("user_id").isNotNull() & F.col("created_at").isNotNull()).groupBy("user_id").agg(
        F.count("id").alias("events_cnt"),
        F.countDistinct("session_id").alias("sessions_cnt"),
        F.countDistinct(F.to_date("created_at")).alias("active_days"),
        F.max("created_at").alias("last_event_at"),
    )
    activity = attach_row(activity, snapshot).select(
        "user_id", "events_cnt", "sessions_cnt", "active_days",
        whole_days(F.col("snapshot_at"), F.col("last_event_at")).alias("days_since_last_event"),
    )
    return (
        users.join(favourite_share(sales), "user_id", "left")
        .join(activity, "user_id", "left")
        .join(user_review_features(review_features), "user_id", "left")
    )
