"""RFM, ABC and XYZ segments of customers and products."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.ordering import (
    Score,
    add_scores,
    medians,
    percentile_score_ends,
    quintile_ends,
    reversed_percentile_score_ends,
    running,
)
from basketry.functions.scalars import attach_row, sample_std, total, whole_days
from basketry.operators.customers import latest_order_lines
from basketry.session import stage

# float noise of a sum or a cumulative share must not move it across a cut
SHARE_DIGITS = 9
SUM_DIGITS = 6


def percentile_scores(df: DataFrame, scores: Sequence[tuple[str, str, bool]], key: str = "user_id") -> DataFrame:
    """Add 1..5 scores ``(name, column, reverse)`` by percentile rank, ties by ``key``.

    Missing values take the column median first. ``df`` must be a staged table.
    """
    columns = list(dict.fromkeys(c for _, c, _ in scores))
    middle = medians(df, columns, "").first()  # one row of literals
    base = df.withColumns(
        {f"_v_{name}": F.coalesce(F.col(c).cast("double"), F.lit(middle[c]).cast("double")) for name, c, _ in scores}
    )
    wanted = [
        Score(f"_s_{name}", f"_v_{name}", reversed_percentile_score_ends if reverse else percentile_score_ends)
        for name, _, reverse in scores
    ]
    labelled = add_scores(base, key, wanted)
    return labelled.select(
        *df.columns,
        *[(F.lit(6) - F.col(f"_s_{name}") if reverse else F.col(f"_s_{name}")).alias(name) for name, _, reverse in scores],
    )


def add_rfm_scores(customers: DataFrame, staged: bool = False) -> DataFrame:
    """rfm_r, rfm_f, rfm_m (1..5) and the three-digit rfm_score."""
    base = (customers if staged else stage(customers, "customers")).withColumn("_spend", F.round("total_spend", SUM_DIGITS))
    scored = percentile_scores(base, [("rfm_r", "recency_days", True), ("rfm_f", "orders", False), ("rfm_m", "_spend", False)])
    return scored.drop("_spend").withColumn("rfm_score", F.col("rfm_r") * 100 + F.col("rfm_f") * 10 + F.col("rfm_m"))


def abc_class(share: Column) -> Column:
    """A up to 80% of the cumulative share, B up to 95%, C beyond."""
    share = F.round(share, SHARE_DIGITS)
    return F.when(share <= 0.80, "A").when(share <= 0.95, "B").otherwise("C")


def xyz_class(variation: Column, low: float, high: float) -> Column:
    variation = F.round(variation, SHARE_DIGITS)
    return F.when(variation <= low, "X").when(variation <= high, "Y").otherwise("Z")


def customer_abc(customers: DataFrame, staged: bool = False) -> DataFrame:
    """ABC class of every customer by cumulative spend, biggest first."""
    base = customers.select("user_id", "total_spend", F.round("total_spend", SUM_DIGITS).alias("_spend"))
    ranked = running(base, "_spend", "user_id", sums=["total_spend"], descending=True, staged=staged)
    share = F.col("cum_total_spend") / F.greatest(F.col("total_total_spend"), F.lit(1.0))
    return ranked.select("user_id", abc_class(share).alias("abc_segment"))


def customer_xyz(lines: DataFrame) -> DataFrame:
    """XYZ class of every customer by the variation of monthly order counts."""
    monthly = (
        latest_order_lines(lines)
        .groupBy("user_id", F.date_format("created_at", "yyyy-MM").alias("month"))
        .agg(F.count(F.lit(1)).alias("monthly_orders"))
    )
    spread = monthly.groupBy("user_id").agg(sample_std(F.col("monthly_orders")).alias("sd"), F.avg("monthly_orders").alias("mean"))
    variation = F.coalesce(F.try_divide("sd", "mean"), F.lit(0.0))
    return spread.select("user_id", xyz_class(variation, 0.50, 1.00).alias("xyz_segment"))


def name_segments(profile: DataFrame) -> DataFrame:
    """Named customer segment (first rule that holds) with the three scores attached."""
    r, f, m = F.col("rfm_r"), F.col("rfm_f"), F.col("rfm_m")
    label = (
        F.when((F.col("abc_segment") == "A") & (f >= 4) & (m >= 4), "champions")
        .when((r <= 2) & (m >= 4), "valuable_sleeping")
        .when((f >= 4) & (m <= 3), "frequent_value_seekers")
        .when((F.col("cancel_rate") > 0.25) | (F.col("return_rate") > 0.15), "service_risk")
        .when(F.col("orders") <= 1, "new_or_one_time")
        .otherwise("regular")
    )
    return profile.withColumn("customer_segment", F.concat(label, F.lit("_"), r.cast("string"), f.cast("string"), m.cast("string")))


# Rule tables for the quintile RFM segments: (label, condition on the three scores), first match wins.
RFM_RULES = {
    "standard": [
        ("Champions", "r_score >= 4 AND f_score >= 4 AND m_score >= 4"),
        ("Loyal", "r_score >= 3 AND f_score >= 3"),
        ("Potential Loyalist", "r_score >= 4 AND f_score <= 2"),
        ("At Risk", "r_score <= 2 AND f_score >= 3"),
        ("Hibernating", "r_score <= 2 AND f_score <= 2"),
    ],
    "strict": [
        ("Champions", "r_score >= 4 AND f_score >= 4 AND m_score >= 4"),
        ("Loyal Customers", "r_score >= 3 AND f_score >= 4"),
        ("Potential Loyalists", "r_score >= 4 AND f_score <= 2"),
        ("At Risk", "r_score <= 2 AND f_score >= 3"),
        ("Hibernating", "r_score <= 2 AND f_score <= 2"),
    ],
}


def rfm_segments(sales: DataFrame, rules: Sequence[tuple[str, str]] = RFM_RULES["standard"]) -> DataFrame:
    """Recency, frequency, monetary, their quintiles, the score text and the segment."""
    snapshot = sales.agg((F.max("created_at") + F.expr("INTERVAL 1 DAY")).alias("snapshot_at"))
    users = sales.where(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.max("created_at").alias("last_purchase"),
        F.countDistinct("order_id").alias("frequency"),
        total(F.col("line_revenue")).alias("monetary"),
    )
    base = stage(
        attach_row(users, snapshot).select(
            "user_id",
            whole_days(F.col("snapshot_at"), F.col("last_purchase")).alias("recency"),
            "frequency",
            "monetary",
            F.round("monetary", SUM_DIGITS).alias("_money"),
        ),
        "rfm",
    )
    scored = add_scores(
        base,
        "user_id",
        [
            Score("r_score", "recency", quintile_ends, descending=True),
            Score("f_score", "frequency", quintile_ends),
            Score("m_score", "_money", quintile_ends),
        ],
    )
    segment = reduce(lambda rest, rule: F.when(F.expr(rule[1]), F.lit(rule[0])).otherwise(rest), reversed(rules), F.lit("Regular"))
    digits = [F.col(c).cast("string") for c in ["r_score", "f_score", "m_score"]]
    return scored.drop("_money").select("*", F.concat(*digits).alias("rfm_score"), segment.alias("rfm_segment"))


def rfm_summary(rfm: DataFrame) -> DataFrame:
    """Size and means of every RFM segment."""
    return (
        rfm.groupBy("rfm_segment")
        .agg(
            F.count("user_id").alias("users_cnt"),
            F.avg("recency").alias("avg_recency"),
            F.avg("frequency").alias("avg_frequency"),
            F.avg("monetary").alias("avg_monetary"),
        )
        .orderBy(F.desc("users_cnt"), "rfm_segment")
    )


def product_abc_xyz(sales: DataFrame) -> DataFrame:
    """ABC by cumulative revenue and XYZ by monthly variation for every product."""
    keys = ["product_id", "product_name", "category"]
    known = sales
    for k in [*keys, "order_month"]:
        known = known.where(F.col(k).isNotNull())
    monthly = known.groupBy(*keys, "order_month").agg(total(F.col("line_revenue")).alias("revenue"))
    products = monthly.groupBy(*keys).agg(
        F.sum("revenue").alias("total_revenue"),
        F.avg("revenue").alias("avg_monthly_revenue"),
        sample_std(F.col("revenue")).alias("std_monthly_revenue"),
        F.count(F.lit(1)).alias("months_active"),
    )
    products = products.withColumn("_order", F.round("total_revenue", SUM_DIGITS))
    ranked = running(products, "_order", "product_id", sums=["total_revenue"], descending=True)
    variation = F.when(F.col("avg_monthly_revenue") > 0, F.col("std_monthly_revenue") / F.col("avg_monthly_revenue")).otherwise(0.0)
    out = ranked.select(
        *keys,
        "total_revenue",
        "avg_monthly_revenue",
        "std_monthly_revenue",
        "months_active",
        variation.alias("cv"),
        (F.col("cum_total_revenue") / F.col("total_total_revenue")).alias("cum_share"),
    )
    out = out.select("*", abc_class(F.col("cum_share")).alias("abc_class"), xyz_class(F.col("cv"), 0.10, 0.25).alias("xyz_class"))
    return out.withColumn("abc_xyz_segment", F.concat("abc_class", "xyz_class"))


def class_counts(products: DataFrame) -> DataFrame:
    """Products in every ABC, XYZ and combined class, from one grouping-sets pass."""
    grouped = products.groupingSets([["abc_class"], ["xyz_class"], ["abc_xyz_segment"]], "abc_class", "xyz_class", "abc_xyz_segment")
    return grouped.agg(F.count(F.lit(1)).alias("products_cnt")).select(
        F.when(F.col("abc_class").isNotNull(), "abc").when(F.col("xyz_class").isNotNull(), "xyz").otherwise("abc_xyz").alias("scheme"),
        F.coalesce("abc_class", "xyz_class", "abc_xyz_segment").alias("class"),
        "products_cnt",
    )
