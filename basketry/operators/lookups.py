"""Published look-up tables: user ids, platform summary, customer overview."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import attach_row


def known_users(predictions: DataFrame, limit: int = 200) -> DataFrame:
    """The first known user ids."""
    return predictions.select("user_id").orderBy("user_id").limit(limit)


def platform_summary(
    predictions: DataFrame, recommendations: DataFrame, outlook: DataFrame, metrics: DataFrame, importance: DataFrame, top: int = 5
) -> DataFrame:
    """One row: users, high-risk share, table sizes, model quality and the top factors."""
    users = predictions.agg(
        F.count_distinct("user_id").alias("users"), F.avg((F.col("risk_group") == "high").cast("int")).alias("high_risk_share")
    )
    rows = recommendations.agg(F.count(F.lit(1)).alias("recommendation_rows"))
    months = outlook.agg(F.count(F.lit(1)).alias("forecast_months"))
    best = importance.orderBy(F.desc("importance"), "feature").limit(top)
    factors = best.agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("k"), "feature"))), lambda x: x["feature"]).alias("top_features")
    )
    out = attach_row(attach_row(users, rows), months)
    return attach_row(attach_row(out, metrics.select(F.col("roc_auc").alias("churn_auc"))), factors)


def one_customer(overview: DataFrame, user_id: int) -> DataFrame:
    """The overview row of one user; empty if there is none."""
    return overview.where(F.col("user_id") == user_id)
