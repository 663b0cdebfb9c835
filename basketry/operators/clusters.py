"""Customer clusters: standardised k-means with restarts, profile and rule labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.ordering import medians
from basketry.functions.scalars import attach_row
from basketry.operators.kmeans import fit_restarts
from basketry.session import stage

# The two sets of clustering inputs.
BEHAVIOUR_FEATURES = [
    "recency", "frequency", "monetary", "return_rate", "avg_delivery_days", "discount_ratio_mean", "unique_categories",
    "favorite_category_share", "events_cnt", "unique_sessions", "days_since_last_event",
]
FULL_FEATURES = [
    "orders_cnt", "items_cnt", "total_revenue", "total_profit", "avg_order_value", "avg_margin_ratio", "return_rate",
    "avg_delivery_days", "avg_shipping_delay_days", "unique_categories", "unique_products", "unique_brands", "recency_days",
    "customer_tenure_days", "purchase_frequency_30d", "favorite_category_share", "events_cnt", "sessions_cnt", "active_days",
    "days_since_last_event", "user_negative_review_rate", "user_positive_review_rate", "user_avg_sentiment_score",
]


def add_clusters(customers: DataFrame, features: Sequence[str], k: int = 5, restarts: int = 20, seed: int = 42) -> DataFrame:
    """Add ``cluster``: the best of several seeded k-means runs, side by side, on standardised features.

    Infinite and missing inputs take the exact median (0 where a column has none); the
    input columns themselves stay as they were.
    """
    base = stage(customers, "cluster-input")
    used = [c for c in features if c in base.columns]
    number = {c: F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in used}
    finite = base.select(*[v.alias(c) for c, v in number.items()])
    middle = medians(finite, used, "").first()
    filled = base.select("user_id", *[F.coalesce(v, F.lit(float(middle[c] or 0.0))).alias(c) for c, v in number.items()])
    raw = VectorAssembler(inputCols=used, outputCol="_raw").transform(filled)
    scaler = StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True).fit(raw)
    data = stage(scaler.transform(raw).select("user_id", vector_to_array("features").alias("x")), "cluster-vectors")
    return base.join(fit_restarts(data, k, restarts, seed).predict(data), "user_id")


def cluster_profile(clustered: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean features (two places) and size of every cluster."""
    used = [c for c in features if c in clustered.columns]
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("users_cnt"), *[F.round(F.avg(c), 2).alias(c) for c in used])


def label_clusters(clustered: DataFrame) -> DataFrame:
    """One row for each cluster: size, means and the first label whose rule holds against
    the means and medians of all customers."""
    summary = clustered.groupBy("cluster").agg(
        F.count("user_id").alias("users_cnt"),
        F.avg("total_revenue").alias("avg_revenue"),
        F.avg("orders_cnt").alias("avg_orders"),
        F.avg("recency_days").alias("avg_recency"),
        F.avg("return_rate").alias("avg_return_rate"),
        F.avg("avg_delivery_days").alias("avg_delivery_days"),
        F.avg("events_cnt").alias("avg_events"),
    )
    overall = clustered.agg(
        F.avg("total_revenue").alias("_revenue"),
        F.avg("return_rate").alias("_returns"),
        F.avg(F.coalesce("events_cnt", F.lit(0))).alias("_events"),
        F.avg("orders_cnt").alias("_orders"),
        F.avg("recency_days").alias("_recency"),
    )
    against = attach_row(attach_row(summary, overall), medians(clustered, ["recency_days"]))
    label = (
        F.when((F.col("avg_revenue") >= F.col("_revenue")) & (F.col("avg_recency") <= F.col("recency_days_median")), "High Value Active")
        .when(F.col("avg_return_rate") >= F.col("_returns") * 1.1, "Return Sensitive")
        .when((F.col("avg_events") >= F.col("_events")) & (F.col("avg_orders") <= F.col("_orders")), "Engaged Browsers")
        .when(F.col("avg_recency") >= F.col("_recency") * 1.1, "At Risk Dormant")
        .otherwise("Core Customers")
    )
    return against.select(*summary.columns, label.alias("cluster_label"))


def with_cluster_label(clustered: DataFrame) -> DataFrame:
    """Customers with the label of their cluster (one row for each of the k clusters)."""
    labels = label_clusters(clustered).select("cluster", "cluster_label")
    return clustered.join(F.broadcast(labels), "cluster", "left")
