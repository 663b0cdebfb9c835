"""Product and category quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import text as tx
from basketry.operators import derive
from basketry.operators import products as pr
from basketry.plans.catalog import query, view
from basketry.plans.customers_queries import REVIEW_LINE_COLUMNS, enriched, reviewed_sales, sales
from basketry.plans.derived_queries import FIXTURE_STOP_WORDS, FIXTURE_SUBSTRINGS, fixture_reviews, sql_list
from basketry.plans.segments_queries import product_abc
from basketry.sources.tables import order_items, reviews

PRODUCT_INPUTS = ["product_id", "product_name", "category", "brand"]


def product_quality(spark, d):
    return pr.product_quality(enriched(spark, d, *PRODUCT_INPUTS))


@query(
    "e03_category_sales",
    "category:s department:s revenue:f margin:f items:i return_rate:f cancel_rate:f avg_price:f quality_risk:f",
    "SELECT category, department, sum(sale_price) AS revenue, sum(margin) AS margin, count(*) AS items, avg(is_returned) AS return_rate, "
    "avg(is_cancelled) AS cancel_rate, avg(sale_price) AS avg_price, avg(is_returned) * 0.55 + avg(is_cancelled) * 0.45 AS quality_risk "
    "FROM enriched GROUP BY ALL",
)
def e03(spark, d):
    return pr.category_sales(enriched(spark, d, "category", "department"))


@query(
    "e04_product_quality",
    "product_id:i product_name:s category:s brand:s revenue:f items:i return_rate:f cancel_rate:f avg_margin:f quality_risk:f",
    "SELECT * FROM product_quality",
)
def e04(spark, d):
    return product_quality(spark, d)


view(
    "flagged_sales",
    "SELECT s.*, CAST(" + " OR ".join(f"contains(lower(coalesce(d.text, '')), '{w}')" for w in FIXTURE_SUBSTRINGS)
    + " AS INTEGER) AS review_negative_flag FROM sales s LEFT JOIN documents d ON s.order_id = d.doc_id",
)
view(
    "product_risk",
    """
WITH p AS (SELECT product_id, product_name, category, sum(line_revenue) AS revenue, count(DISTINCT order_id) AS orders_cnt,
    avg(is_returned) AS return_rate, avg(review_negative_flag) AS negative_review_rate, avg(delivery_days) AS avg_delivery_days
    FROM flagged_sales GROUP BY ALL),
  f AS (SELECT *, coalesce(avg_delivery_days, median(avg_delivery_days) OVER ()) AS filled FROM p)
SELECT *, 0.5 * return_rate + 0.3 * negative_review_rate + 0.2 * (filled / max(filled) OVER ()) AS quality_risk_score FROM f
""",
)
RISK_SPEC = (
    "product_id:i product_name:s category:s revenue:f orders_cnt:i return_rate:f negative_review_rate:f avg_delivery_days:f "
    "quality_risk_score:f"
)


def product_risk(spark, d):
    lines = derive.enrich_sales(order_items(spark, d, *REVIEW_LINE_COLUMNS))
    flagged = lines.withColumn("review_negative_flag", tx.mentions_any(F.col("customer_review"), FIXTURE_SUBSTRINGS))
    return pr.product_risk(flagged)


@query("e18_product_risk", RISK_SPEC, "SELECT * FROM product_risk")
def e18(spark, d):
    return product_risk(spark, d)


view(
    "product_reviews",
    "SELECT product_id, product_name, count(review_text) AS review_count, avg(review_word_count) AS avg_review_len, "
    "avg(review_negative_flag) AS negative_review_rate, avg(review_positive_flag) AS positive_review_rate, "
    "avg(review_sentiment_score) AS avg_sentiment_score, avg(is_returned) AS return_rate, sum(line_revenue) AS revenue "
    "FROM reviewed_sales GROUP BY ALL",
)
REVIEW_MART_SPEC = (
    "product_id:i product_name:s review_count:i avg_review_len:f negative_review_rate:f positive_review_rate:f avg_sentiment_score:f "
    "return_rate:f revenue:f"
)


@query("e22_product_reviews", REVIEW_MART_SPEC, "SELECT * FROM product_reviews")
def e22(spark, d):
    return pr.product_reviews(reviewed_sales(spark, d))


@query(
    "e22_reviewed_products",
    REVIEW_MART_SPEC,
    "SELECT * FROM product_reviews WHERE review_count >= 10 ORDER BY negative_review_rate DESC, review_count DESC, product_id LIMIT 20",
)
def e22_top(spark, d):
    return pr.reviewed_products(pr.product_reviews(reviewed_sales(spark, d)))


@query(
    "e24_negative_words",
    "word:s freq:i",
    "SELECT word, count(*) AS freq FROM (SELECT unnest(string_split(review_text_clean, ' ')) AS word FROM review_rows "
    f"WHERE review_negative_flag = 1) WHERE length(word) > 2 AND word NOT IN {sql_list(FIXTURE_STOP_WORDS)} "
    "GROUP BY word ORDER BY freq DESC, word LIMIT 20",
)
def e24(spark, d):
    return tx.frequent_negative_words(fixture_reviews(reviews(spark, d)), FIXTURE_STOP_WORDS)


view(
    "quality_mart",
    """
WITH p AS (SELECT product_id, product_name, category, count(review_text) AS review_count, sum(line_revenue) AS revenue,
    count(DISTINCT order_id) AS orders_cnt, avg(is_returned) AS return_rate, avg(delivery_days) AS avg_delivery_days,
    avg(margin_ratio) AS avg_margin_ratio, avg(review_negative_flag) AS negative_review_rate,
    avg(review_positive_flag) AS positive_review_rate, avg(review_sentiment_score) AS avg_sentiment_score
    FROM reviewed_sales GROUP BY ALL),
  f AS (SELECT *, coalesce(avg_delivery_days, median(avg_delivery_days) OVER ()) AS filled FROM p),
  g AS (SELECT *, filled / max(filled) OVER () AS delivery_risk_component FROM f),
  h AS (SELECT *, 0.45 * return_rate + 0.35 * negative_review_rate + 0.20 * coalesce(delivery_risk_component, 0) AS quality_risk_score FROM g),
  i AS (SELECT *, CASE WHEN round(quality_risk_score, 9) <= 0.08 THEN 'Low Risk' WHEN round(quality_risk_score, 9) <= 0.16 THEN 'Medium Risk'
    ELSE 'High Risk' END AS quality_label FROM h)
SELECT *, CAST(quality_label = 'High Risk' AND orders_cnt >= 10 AS INTEGER) AS exclude_from_reco FROM i
""",
)


@query(
    "e26_product_quality_mart",
    "product_id:i product_name:s category:s review_count:i revenue:f orders_cnt:i return_rate:f avg_delivery_days:f avg_margin_ratio:f "
    "negative_review_rate:f positive_review_rate:f avg_sentiment_score:f delivery_risk_component:f quality_risk_score:f quality_label:s "
    "exclude_from_reco:i",
    "SELECT * FROM quality_mart",
)
def e26(spark, d):
    return pr.product_quality_mart(reviewed_sales(spark, d))


@query(
    "e27_category_quality_mart",
    "category:s products_cnt:i revenue:f avg_return_rate:f avg_negative_review_rate:f avg_sentiment_score:f avg_quality_risk_score:f "
    "excluded_products_cnt:i",
    "SELECT category, count(DISTINCT product_id) AS products_cnt, sum(revenue) AS revenue, avg(return_rate) AS avg_return_rate, "
    "avg(negative_review_rate) AS avg_negative_review_rate, avg(avg_sentiment_score) AS avg_sentiment_score, "
    "avg(quality_risk_score) AS avg_quality_risk_score, sum(exclude_from_reco) AS excluded_products_cnt FROM quality_mart GROUP BY category",
)
def e27(spark, d):
    return pr.category_quality_mart(pr.product_quality_mart(reviewed_sales(spark, d)))


@query(
    "e31_product_mart",
    RISK_SPEC + " abc_class:s xyz_class:s abc_xyz:s",
    "SELECT r.*, a.abc_class, a.xyz_class, a.abc_xyz_segment AS abc_xyz FROM product_risk r LEFT JOIN product_abc a USING (product_id)",
)
def e31_product(spark, d):
    classes = product_abc(spark, d).select("product_id", "abc_class", "xyz_class", F.col("abc_xyz_segment").alias("abc_xyz"))
    return product_risk(spark, d).join(classes, "product_id", "left")
