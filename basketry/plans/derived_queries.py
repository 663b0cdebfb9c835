"""Derived-column queries (flags, durations, money, calendar, text)."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.functions import text as tx
from basketry.functions.scalars import age_group, risk_band
from basketry.operators import derive
from basketry.plans import fixture_views  # noqa: F401  (registers the SQL views)
from basketry.plans.catalog import query, view
from basketry.sources.tables import load, order_items, reviews

# Frequent tokens of the invented review texts, used in place of the English lexicons.
FIXTURE_POSITIVE = ["the", "of", "and", "un", "et", "der", "die", "los"]
FIXTURE_NEGATIVE = ["is", "on", "that", "la", "que", "und", "das", "les"]
FIXTURE_SUBSTRINGS = ["ationth", "bad", "late", "return", "ouen"]
FIXTURE_STOP_WORDS = ["the", "and", "that", "les", "und", "que"]


def fixture_reviews(df):
    """Review features with the lexicons that fit the test texts."""
    return tx.review_features(df, positive=FIXTURE_POSITIVE, negative=FIXTURE_NEGATIVE)


def sql_list(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def review_sql(source: str, columns: str) -> str:
    """SQL of the review features over ``source`` (a table with customer_review)."""
    pos, neg = sql_list(FIXTURE_POSITIVE), sql_list(FIXTURE_NEGATIVE)
    return f"""
WITH a AS (SELECT *, coalesce(customer_review, 'Unknown') AS review_text FROM {source}),
  b AS (SELECT *, trim(regexp_replace(lower(review_text), '[^a-z]+', ' ', 'g')) AS review_text_clean FROM a),
  c AS (SELECT *, CASE WHEN review_text_clean = '' THEN [] ELSE string_split(review_text_clean, ' ') END AS words FROM b),
  d AS (SELECT * EXCLUDE (words), length(review_text) AS review_char_len, len(words) AS review_word_count,
    len(list_distinct(words)) AS review_unique_word_count,
    length(review_text) - length(replace(review_text, '!', '')) AS review_exclamation_count,
    length(review_text) - length(replace(review_text, '?', '')) AS review_question_count,
    CAST(review_text <> 'Unknown' AS INTEGER) AS has_review,
    len(list_filter(words, lambda w: w IN {pos})) AS positive_word_count,
    len(list_filter(words, lambda w: w IN {neg})) AS negative_word_count FROM c)
SELECT {columns}, review_text, review_text_clean, review_char_len, review_word_count, review_unique_word_count,
  review_exclamation_count, review_question_count, has_review, positive_word_count, negative_word_count,
  positive_word_count - negative_word_count AS review_sentiment_score,
  CAST(negative_word_count > positive_word_count AS INTEGER) AS review_negative_flag,
  CAST(positive_word_count > negative_word_count AS INTEGER) AS review_positive_flag FROM d"""


view("review_docs", "SELECT doc_id, text AS customer_review FROM documents")
view("review_rows", review_sql("review_docs", "doc_id"))
view(
    "reviewed_lines",
    "SELECT s.*, d.text AS customer_review FROM sales s LEFT JOIN documents d ON s.order_id = d.doc_id",
)
view(
    "reviewed_sales",
    review_sql(
        "reviewed_lines",
        "user_id, product_id, product_name, category, order_id, line_revenue, is_returned, delivery_days, margin_ratio",
    ),
)


@query(
    "d01_status_flags",
    "status:s returned_at:t is_returned:i is_cancelled:i is_completed:i is_shipped:i lines:i",
    "SELECT status, returned_at, is_returned, is_cancelled, is_completed, is_shipped, count(*) AS lines FROM enriched GROUP BY ALL",
)
def d01(spark, d):
    flags = derive.status_flags(order_items(spark, d, "status", "returned_at"))
    return flags.groupBy(*flags.columns).agg(F.count(F.lit(1)).alias("lines"))


@query(
    "d02_loose_status_flags",
    "status:s is_returned:i is_shipped:i is_delivered:i is_cancelled:i lines:i",
    "SELECT status, is_returned, is_shipped, is_delivered, is_cancelled, count(*) AS lines FROM sales GROUP BY ALL",
)
def d02(spark, d):
    flags = derive.loose_status_flags(order_items(spark, d, "status", "returned_at", "shipped_at", "delivered_at"))
    return flags.groupBy("status", "is_returned", "is_shipped", "is_delivered", "is_cancelled").agg(F.count(F.lit(1)).alias("lines"))


@query(
    "d03_durations",
    "order_id:i product_id:i shipping_delay_days:f delivery_days:f return_days:f delivery_gap_days:f",
    "SELECT order_id, product_id, raw_shipping AS shipping_delay_days, raw_delivery AS delivery_days, raw_return AS return_days, "
    "raw_gap AS delivery_gap_days FROM sales_base",
)
def d03(spark, d):
    return derive.durations(order_items(spark, d, "order_id", "product_id", "created_at", "shipped_at", "delivered_at", "returned_at"))


@query(
    "d04_valid_durations",
    "order_id:i product_id:i shipping_delay_days:f delivery_days:f return_days:f delivery_gap_days:f",
    "SELECT order_id, product_id, shipping_delay_days, delivery_days, return_days, delivery_gap_days FROM sales",
)
def d04(spark, d):
    return derive.valid_durations(
        order_items(spark, d, "order_id", "product_id", "created_at", "shipped_at", "delivered_at", "returned_at")
    )


@query(
    "d05_line_money",
    "order_id:i product_id:i line_revenue:f line_cost:f line_profit:f margin:f",
    "SELECT order_id, product_id, line_revenue, line_cost, line_profit, sale_price - cost AS margin FROM sales",
)
def d05(spark, d):
    return derive.line_money(derive.unit_margin(order_items(spark, d, "order_id", "product_id", "sale_price", "cost", "num_of_item")))


@query(
    "d06_money_ratios",
    "order_id:i product_id:i discount_ratio:f margin_ratio:f unit_margin_ratio:f",
    "SELECT order_id, product_id, discount_ratio, margin_ratio, "
    "CASE WHEN sale_price = 0 THEN 0 ELSE (sale_price - cost) / sale_price END AS unit_margin_ratio FROM sales",
)
def d06(spark, d):
    lines = order_items(spark, d, "order_id", "product_id", "sale_price", "cost", "retail_price", "num_of_item")
    unit = derive.unit_margin_ratio(lines).withColumnRenamed("margin_ratio", "unit_margin_ratio")
    return derive.money_ratios(derive.line_money(unit))


@query(
    "d07_calendar",
    "order_date:d order_month:s order_week:i day_of_week:s hour:i orders:i",
    "SELECT CAST(o_orderdate AS DATE) AS order_date, strftime(o_orderdate, '%Y-%m') AS order_month, weekofyear(o_orderdate) AS order_week, "
    "dayname(o_orderdate) AS day_of_week, hour(o_orderdate) AS hour, count(*) AS orders FROM orders GROUP BY ALL",
)
def d07(spark, d):
    dated = derive.calendar(load(spark, d, "orders").select(F.col("o_orderdate").alias("created_at")))
    return dated.groupBy("order_date", "order_month", "order_week", "day_of_week", "hour").agg(F.count(F.lit(1)).alias("orders"))


@query(
    "d08_age_group",
    "user_id:i age:f age_group:s",
    "SELECT user_id, age, CASE WHEN age > 14 AND age <= 24 THEN '14-24' WHEN age > 24 AND age <= 34 THEN '25-34' "
    "WHEN age > 34 AND age <= 44 THEN '35-44' WHEN age > 44 AND age <= 54 THEN '45-54' WHEN age > 54 AND age <= 64 THEN '55-64' "
    "WHEN age > 64 AND age <= 100 THEN '65+' END AS age_group FROM order_items",
)
def d08(spark, d):
    return order_items(spark, d, "user_id", "age").withColumn("age_group", age_group(F.col("age")))


@query(
    "d09_negative_flag",
    "doc_id:i review_negative_flag:i",
    "SELECT doc_id, CAST(" + " OR ".join(f"contains(lower(text), '{w}')" for w in FIXTURE_SUBSTRINGS) + " AS INTEGER) AS review_negative_flag FROM documents",
)
def d09(spark, d):
    flag = tx.mentions_any(F.col("customer_review"), FIXTURE_SUBSTRINGS)
    return reviews(spark, d).withColumn("review_negative_flag", flag)


@query(
    "d10_review_features",
    "doc_id:i review_text_clean:s review_char_len:i review_word_count:i review_unique_word_count:i review_exclamation_count:i "
    "review_question_count:i has_review:i positive_word_count:i negative_word_count:i review_sentiment_score:i "
    "review_negative_flag:i review_positive_flag:i",
    "SELECT * FROM review_rows",
)
def d10(spark, d):
    return fixture_reviews(reviews(spark, d))


@query(
    "d11_risk_band",
    "order_id:i product_id:i score:f risk_group:s",
    "SELECT order_id, product_id, score, CASE WHEN score <= 0.35 THEN 'low' WHEN score <= 0.65 THEN 'medium' ELSE 'high' END AS risk_group "
    "FROM (SELECT l_orderkey AS order_id, l_partkey AS product_id, l_quantity / 50 AS score FROM lineitem)",
)
def d11(spark, d):
    scored = load(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), (F.col("l_quantity") / 50).alias("score")
    )
    return scored.withColumn("risk_group", risk_band(F.col("score")))
