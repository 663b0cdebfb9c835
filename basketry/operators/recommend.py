"""Rule-based recommendations: good products, retention offers, last resort, tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.ordering import quantiles
from basketry.functions.scalars import attach_row, total, whole_days
from basketry.operators.cleaning import min_max

REASON = "retention_offer_low_quality_risk"


def offer_order() -> list[Column]:
    """Least risk, then most revenue, then best margin; rounded so float noise cannot decide."""
    return [
        F.col("quality_risk").asc(),
        F.round("revenue", 6).desc(),
        F.round("avg_margin", 6).desc(),
        F.col("product_id").asc(),
    ]


def good_products(quality: DataFrame) -> DataFrame:
    """Products at or under the third risk quartile with enough sold items; all if none is."""
    cuts = attach_row(
        quantiles(quality, ["quality_risk"], [0.75]).select(F.col("quality_risk")[0].alias("_risk_cut")),
        quantiles(quality, ["items"], [0.10]).select(F.greatest(F.lit(3.0), F.col("items")[0]).alias("_item_cut")),
    )
    is_good = (F.col("quality_risk") <= F.col("_risk_cut")) & (F.col("items") >= F.col("_item_cut"))
    flagged = attach_row(quality, cuts).withColumn("_good", is_good)
    any_good = flagged.agg(F.coalesce(F.max("_good"), F.lit(False)).alias("_any"))
    return attach_row(flagged, any_good).where(F.col("_good") | ~F.col("_any")).select(*quality.columns)


def riskiest_users(predictions: DataFrame, limit: int | None = 5000) -> DataFrame:
    """Users by churn probability, highest first."""
    users = predictions.select("user_id", "churn_probability").orderBy(F.desc("churn_probability"), "user_id")
    return users.limit(limit) if limit is not None else users


def retention_offers(
    lines: DataFrame,
    quality: DataFrame,
    users: DataFrame,
    offers: int = 3,
    per_category: int = 5,
    global_top: int = 30,
    outside: int = 10,
) -> DataFrame:
    """Offers for every user: the best products of each bought category (categories by name),
    then the best products overall from other categories; each product once, first ``offers``.

    Set-based: a join on category plus at most ``global_top`` rows for each user. Ranks below
    a limit are cut map-side before any shuffle.
    """
    good = good_products(quality).select("product_id", "product_name", "category", "brand", "quality_risk", "revenue", "avg_margin")
    item = F.struct("product_id", "product_name", "category", "brand", "quality_risk").alias("item")
    place = F.row_number().over(Window.partitionBy("category").orderBy(*offer_order()))
    top_in_category = good.withColumn("place", place).where(F.col("place") <= per_category).select("category", "place", item)
    bought = (
        lines.where(F.col("category").isNotNull())
        .join(users.select("user_id"), "user_id", "left_semi")
        .select("user_id", "category")
        .distinct()
    )
    inside = bought.join(top_in_category, "category").select(
        "user_id", F.struct(F.lit(0).alias("tier"), "category", "place").alias("position"), "item"
    )
    # a fixed number of rows: one packed row, so nothing is joined pairwise
    best = good.orderBy(*offer_order()).limit(global_top)
    best = best.withColumn("place", F.row_number().over(Window.orderBy(*offer_order()))).select("place", item)
    packed = best.agg(F.sort_array(F.collect_list(F.struct("place", "item"))).alias("best"))
    spread = attach_row(users.select("user_id"), packed).select("user_id", F.inline("best"))
    spread = spread.withColumn("category", F.col("item.category")).join(bought, ["user_id", "category"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("place"))
    beyond = spread.withColumn("_nth", nth).where(F.col("_nth") <= outside).select(
        "user_id", F.struct(F.lit(1).alias("tier"), F.lit("").alias("category"), "place").alias("position"), "item"
    )
    once = inside.unionByName(beyond).groupBy("user_id", F.col("item.product_id").alias("product_id")).agg(
        F.min(F.struct("position", "item")).alias("pick")
    )
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("pick.position", "product_id"))
    ranked = once.withColumn("rank", rank).where(F.col("rank") <= offers)
    out = ranked.join(users, "user_id").select(
        *users.columns,
        "rank",
        F.col("product_id").alias("recommended_product_id"),
        F.col("pick.item.product_name").alias("recommended_product"),
        F.col("pick.item.category").alias("category"),
        F.col("pick.item.brand").alias("brand"),
        F.lit(REASON).alias("reason"),
        F.col("pick.item.quality_risk").alias("quality_risk"),
    )
    return out


def fallback_offers(predictions: DataFrame, quality: DataFrame, offers: int = 5) -> DataFrame:
    """The same best products for every user, scored ``1 - risk + 0.1 * churn``."""
    best = quality.orderBy(*offer_order()).limit(offers)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(*offer_order())))
    packed = best.agg(
        F.collect_list(F.struct("rank", F.col("product_id").alias("recommended_product_id"), "product_name", "category", "brand", F.col("quality_risk").alias("item_quality_risk"))).alias("best")
    )
    spread = attach_row(predictions.select("user_id", "churn_probability"), packed).select("user_id", "churn_probability", F.inline("best"))
    score = 1.0 - F.col("item_quality_risk") + F.coalesce("churn_probability", F.lit(0.0)) * 0.1
    return spread.select(
        "user_id", "rank", "recommended_product_id", "product_name", "category", "brand", score.alias("score"), "item_quality_risk",
        F.lit("business_rule_fallback").alias("source"),
    )


OFFER_COLUMNS = ["user_id", "rank", "recommended_product_id", "product_name", "category", "brand", "score", "item_quality_risk", "source"]


def rule_offers_as_tier(offers: DataFrame) -> DataFrame:
    """Retention offers in the common offer shape, scored ``1 - risk``."""
    return offers.select(
        "user_id", "rank", "recommended_product_id", F.col("recommended_product").alias("product_name"), "category", "brand",
        (1.0 - F.col("quality_risk")).alias("score"), F.col("quality_risk").alias("item_quality_risk"), F.lit("retention_rules").alias("source"),
    )


def tiered_offers(tiers: Sequence[DataFrame], offers: int = 5) -> DataFrame:
    """For every user the first tier that has offers, its first ``offers`` rows."""
    stacked = None
    for priority, tier in enumerate(tiers):
        part = tier.select(*OFFER_COLUMNS, F.lit(priority).alias("_tier"))
        stacked = part if stacked is None else stacked.unionByName(part)
    best = stacked.groupBy("user_id").agg(F.min("_tier").alias("_tier"))
    return stacked.join(best, ["user_id", "_tier"]).where(F.col("rank") <= offers).select(*OFFER_COLUMNS)


def newest_orders(lines: DataFrame) -> DataFrame:
    """The newest order of every user with two or more; of equally new ones the smallest id.

    A struct max, so a user with very many orders is combined map-side.
    """
    dated = lines.where(F.col("user_id").isNotNull() & F.col("order_id").isNotNull())
    by_order = dated.groupBy("user_id", "order_id").agg(F.max("created_at").alias("at"))
    newest = by_order.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_orders"), F.max(F.when(F.col("at").isNotNull(), F.struct("at", (-F.col("order_id")).alias("minus_id")))).alias("_new")
    )
    return newest.where((F.col("_orders") >= 2) & F.col("_new").isNotNull()).select("user_id", (-F.col("_new.minus_id")).alias("order_id"))


def temporal_split(lines: DataFrame, users: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test): test holds the newest order of every eligible user (of ``users``, if given)."""
    newest = newest_orders(lines)
    if users is not None:
        newest = newest.join(users.select("user_id"), "user_id", "left_semi")
    keys = ["user_id", "order_id"]
    return lines.join(newest, keys, "left_anti"), lines.join(newest, keys, "left_semi")


def offer_targets(lines: DataFrame, interactions: DataFrame, limit: int | None = 5000) -> DataFrame:
    """Users to address: inactive, cancelling, returning and rare buyers first."""
    newest = lines.agg(F.max("created_at").alias("_latest"))
    stats = lines.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.max("created_at").alias("_last"),
        F.countDistinct("order_id").alias("orders"),
        total(F.col("sale_price")).alias("spend"),
        F.avg("is_cancelled").alias("cancel_rate"),
        F.avg("is_returned").alias("return_rate"),
    )
    stats = attach_row(stats, newest).withColumn("recency_days", whole_days(F.col("_latest"), F.col("_last")))
    scaled = min_max(stats, {c: f"_m_{c}" for c in ["recency_days", "cancel_rate", "return_rate", "orders"]})
    score = (
        F.col("_m_recency_days") * 0.45 + F.col("_m_cancel_rate") * 0.25 + F.col("_m_return_rate") * 0.20 + (1 - F.col("_m_orders")) * 0.10
    )
    known = interactions.select(F.col("UserId").alias("user_id")).distinct()
    out = scaled.join(known, "user_id", "left_semi").select("user_id", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "user_id")
    return out.limit(limit) if limit is not None else out
