"""Product and category quality tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.ordering import medians
from basketry.functions.scalars import attach_row, total
from basketry.session import stage


def _with_keys(df: DataFrame, *keys: str) -> DataFrame:
    for key in keys:
        df = df.where(F.col(key).isNotNull())
    return df


def service_risk(return_rate: Column, cancel_rate: Column) -> Column:
    return return_rate * 0.55 + cancel_rate * 0.45


def category_sales(lines: DataFrame) -> DataFrame:
    """Sales and service quality of every category and department."""
    out = _with_keys(lines, "category", "department").groupBy("category", "department").agg(
        total(F.col("sale_price")).alias("revenue"),
        total(F.col("margin")).alias("margin"),
        F.count(F.lit(1)).alias("items"),
        F.avg("is_returned").alias("return_rate"),
        F.avg("is_cancelled").alias("cancel_rate"),
        F.avg("sale_price").alias("avg_price"),
    )
    return out.withColumn("quality_risk", service_risk(F.col("return_rate"), F.col("cancel_rate")))


def product_quality(lines: DataFrame) -> DataFrame:
    """Sales and service quality of every product."""
    keys = ["product_id", "product_name", "category", "brand"]
    out = _with_keys(lines, *keys).groupBy(*keys).agg(
        total(F.col("sale_price")).alias("revenue"),
        F.count(F.lit(1)).alias("items"),
        F.avg("is_returned").alias("return_rate"),
        F.avg("is_cancelled").alias("cancel_rate"),
        F.avg("margin").alias("avg_margin"),
    )
    return out.withColumn("quality_risk", service_risk(F.col("return_rate"), F.col("cancel_rate")))


def _delivery_share(products: DataFrame) -> DataFrame:
    """Mean delivery time, missing ones at the product median, over the largest."""
    products = stage(products, "products")
    filled = F.coalesce(F.col("avg_delivery_days"), F.col("avg_delivery_days_median"))
    with_median = attach_row(products, medians(products, ["avg_delivery_days"])).withColumn("_filled", filled)
    largest = with_median.agg(F.max("_filled").alias("_largest"))
    return attach_row(with_median, largest).select(
        *products.columns, F.try_divide("_filled", "_largest").alias("delivery_risk_component")
    )


def product_risk(sales: DataFrame) -> DataFrame:
    """Product quality from returns, negative reviews and delivery time."""
    keys = ["product_id", "product_name", "category"]
    products = _with_keys(sales, *keys).groupBy(*keys).agg(
        total(F.col("line_revenue")).alias("revenue"),
        F.countDistinct("order_id").alias("orders_cnt"),
        F.avg("is_returned").alias("return_rate"),
        F.avg("review_negative_flag").alias("negative_review_rate"),
        F.avg("delivery_days").alias("avg_delivery_days"),
    )
    out = _delivery_share(products)
    score = (
        0.5 * F.coalesce("return_rate", F.lit(0.0))
        + 0.3 * F.coalesce("negative_review_rate", F.lit(0.0))
        + 0.2 * F.col("delivery_risk_component")
    )
    return out.select(*products.columns, score.alias("quality_risk_score"))


def product_reviews(sales: DataFrame) -> DataFrame:
    """Review features of every product, most negative first."""
    out = _with_keys(sales, "product_id", "product_name").groupBy("product_id", "product_name").agg(
        F.count("review_text").alias("review_count"),
        F.avg("review_word_count").alias("avg_review_len"),
        F.avg("review_negative_flag").alias("negative_review_rate"),
        F.avg("review_positive_flag").alias("positive_review_rate"),
        F.avg("review_sentiment_score").alias("avg_sentiment_score"),
        F.avg("is_returned").alias("return_rate"),
        total(F.col("line_revenue")).alias("revenue"),
    )
    return out.orderBy(F.desc("negative_review_rate"), "product_id")


def reviewed_products(reviews: DataFrame, min_reviews: int = 10, top: int | None = 20) -> DataFrame:
    """Products with enough reviews, worst first."""
    out = reviews.where(F.col("review_count") >= min_reviews).orderBy(
        F.desc("negative_review_rate"), F.desc("review_count"), "product_id"
    )
    return out.limit(top) if top is not None else out


def product_quality_mart(sales: DataFrame) -> DataFrame:
    """Product quality score, label and the flag that keeps a product out of offers."""
    keys = ["product_id", "product_name", "category"]
    products = _with_keys(sales, *keys).groupBy(*keys).agg(
        F.count("review_text").alias("review_count"),
        total(F.col("line_revenue")).alias("revenue"),
        F.countDistinct("order_id").alias("orders_cnt"),
        F.avg("is_returned").alias("return_rate"),
        F.avg("delivery_days").alias("avg_delivery_days"),
        F.avg("margin_ratio").alias("avg_margin_ratio"),
        F.avg("review_negative_flag").alias("negative_review_rate"),
        F.avg("review_positive_flag").alias("positive_review_rate"),
        F.avg("review_sentiment_score").alias("avg_sentiment_score"),
    )
    zero = F.lit(0.0)
    score = (
        0.45 * F.coalesce("return_rate", zero)
        + 0.35 * F.coalesce("negative_review_rate", zero)
        + 0.20 * F.coalesce("delivery_risk_component", zero)
    )
    out = _delivery_share(products).withColumn("quality_risk_score", score)
    label = (
        F.when(F.round("quality_risk_score", 9) <= 0.08, "Low Risk")
        .when(F.round("quality_risk_score", 9) <= 0.16, "Medium Risk")
        .otherwise("High Risk")
    )
    out = out.withColumn("quality_label", label)
    exclude = (F.col("quality_label") == "High Risk") & (F.col("orders_cnt") >= 10)
    return out.withColumn("exclude_from_reco", exclude.cast("int"))


def category_quality_mart(products: DataFrame) -> DataFrame:
    """Category view of the product quality mart, riskiest first."""
    out = products.groupBy("category").agg(
        F.countDistinct("product_id").alias("products_cnt"),
        total(F.col("revenue")).alias("revenue"),
        F.avg("return_rate").alias("avg_return_rate"),
        F.avg("negative_review_rate").alias("avg_negative_review_rate"),
        F.avg("avg_sentiment_score").alias("avg_sentiment_score"),
        F.avg("quality_risk_score").alias("avg_quality_risk_score"),
        F.sum("exclude_from_reco").alias("excluded_products_cnt"),
    )
    return out.orderBy(F.desc("avg_quality_risk_score"), "category")
