"""Customer feature queries."""

from __future__ import annotations

from basketry.functions.scalars import numeric_columns  # noqa: F401
from basketry.operators import customers as cu
from basketry.operators import derive
from basketry.operators import segments as sg
from basketry.plans.catalog import mode_sql, query, view
from basketry.plans.derived_queries import fixture_reviews
from basketry.session import stage
from basketry.sources.tables import event_log, order_items

# The test events name their types differently; these play the five roles.
FIXTURE_ROLES = {"cart": "click", "purchase": "purchase", "cancel": "error", "product": "view", "department": "signup"}
FIXTURE_EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

REVIEW_LINE_COLUMNS = [
    "user_id", "product_id", "product_name", "category", "order_id", "sale_price", "cost", "retail_price", "num_of_item",
    "created_at", "shipped_at", "delivered_at", "returned_at", "status", "customer_review",
]


def enriched(spark, d, *columns, by_product=False):
    """Enriched order lines; with ``columns``, only what those need."""
    base = ["status", "created_at", "shipped_at", "delivered_at", "returned_at", "sale_price", "cost"]
    names = list(dict.fromkeys([*columns, *base])) if columns else []
    return derive.enrich_orders(order_items(spark, d, *names, by_product=by_product))


def sales(spark, d, *columns):
    base = ["status", "created_at", "shipped_at", "delivered_at", "returned_at", "sale_price", "cost", "retail_price", "num_of_item"]
    names = list(dict.fromkeys([*columns, *base])) if columns else []
    return derive.enrich_sales(order_items(spark, d, *names))


def reviewed_sales(spark, d):
    return fixture_reviews(derive.enrich_sales(order_items(spark, d, *REVIEW_LINE_COLUMNS)))


CUSTOMER_INPUTS = [
    "order_id", "user_id", "product_id", "category", "age", "gender", "country", "city", "traffic_source", "is_loyal",
]


def customer_features(spark, d):
    return cu.customer_features(enriched(spark, d, *CUSTOMER_INPUTS))


def customer_profile(spark, d):
    """Features, scores, classes, event features and the named segment of every customer."""
    lines = stage(enriched(spark, d, *CUSTOMER_INPUTS), "lines")
    base = stage(cu.customer_features(lines), "customers")
    scored = sg.add_rfm_scores(base, staged=True)
    full = scored.join(sg.customer_abc(base, staged=True), "user_id").join(sg.customer_xyz(lines), "user_id")
    full = cu.join_event_features(full, cu.event_features(event_log(spark, d), FIXTURE_ROLES))
    return sg.name_segments(full)


@query(
    "e01_latest_order_lines",
    "user_id:i order_id:i created_at:t is_cancelled:i is_completed:i",
    "SELECT * FROM order_level",
)
def e01(spark, d):
    return cu.latest_order_lines(enriched(spark, d, "order_id", "user_id"))


CUSTOMER_SPEC = (
    "user_id:i items:i total_spend:f total_margin:f unique_products:i unique_categories:i avg_item_price:f returned_items:i "
    "cancelled_items:i completed_items:i shipped_items:i avg_shipping_days:f avg_delivery_days:f age:f gender:s country:s city:s "
    "traffic_source:s is_loyal:b first_order:t last_order:t orders:i cancelled_orders:i completed_orders:i avg_order_value:f "
    "return_rate:f cancel_rate:f completion_rate:f recency_days:i tenure_days:i purchase_frequency:f"
)


@query("e02_customer_features", CUSTOMER_SPEC, "SELECT * FROM customer_base")
def e02(spark, d):
    return customer_features(spark, d)


EVENT_SPEC = (
    "event_count:i sessions:i first_event:t last_event:t event_cart:i event_purchase:i event_cancel:i event_product:i "
    "event_department:i events_per_session:f cart_to_purchase_rate:f cancel_event_rate:f"
)


@query("e05_event_features", "user_id:i " + EVENT_SPEC, "SELECT * FROM event_features")
def e05(spark, d):
    return cu.event_features(event_log(spark, d), FIXTURE_ROLES)


@query(
    "e06_join_event_features",
    "user_id:i orders:i " + EVENT_SPEC,
    "SELECT c.user_id, c.orders, coalesce(event_count, 0) AS event_count, coalesce(sessions, 0) AS sessions, first_event, last_event, "
    "coalesce(event_cart, 0) AS event_cart, coalesce(event_purchase, 0) AS event_purchase, coalesce(event_cancel, 0) AS event_cancel, "
    "coalesce(event_product, 0) AS event_product, coalesce(event_department, 0) AS event_department, "
    "coalesce(events_per_session, 0) AS events_per_session, coalesce(cart_to_purchase_rate, 0) AS cart_to_purchase_rate, "
    "coalesce(cancel_event_rate, 0) AS cancel_event_rate FROM customer_base c LEFT JOIN event_features e USING (user_id)",
)
def e06(spark, d):
    features = cu.event_features(event_log(spark, d), FIXTURE_ROLES)
    return cu.join_event_features(customer_features(spark, d).select("user_id", "orders"), features)


for _c in ["browser", "event_type"]:
    view(f"event_mode_{_c}", mode_sql("event_log", "user_id", _c, "user_id IS NOT NULL"))

view(
    "event_activity",
    "SELECT e.*, coalesce(b.browser, 'Unknown') AS favorite_browser, coalesce(t.event_type, 'Unknown') AS favorite_event_type, "
    "CAST(floor((epoch_us((SELECT max(created_at) FROM event_log WHERE user_id IS NOT NULL)) - epoch_us(last_event_at)) / 86400e6) AS BIGINT) "
    "AS days_since_last_event FROM (SELECT user_id, count(id) AS events_cnt, count(DISTINCT session_id) AS unique_sessions, "
    "count(DISTINCT CAST(created_at AS DATE)) AS active_days, max(created_at) AS last_event_at, "
    + ", ".join(f"count(*) FILTER (event_type = '{t}') AS event_type_{t}_cnt" for t in FIXTURE_EVENT_TYPES)
    + " FROM event_log WHERE user_id IS NOT NULL GROUP BY user_id) e LEFT JOIN event_mode_browser b USING (user_id) "
    "LEFT JOIN event_mode_event_type t USING (user_id)",
)

ACTIVITY_SPEC = (
    "events_cnt:i unique_sessions:i active_days:i last_event_at:t favorite_browser:s favorite_event_type:s event_type_click_cnt:i "
    "event_type_error_cnt:i event_type_purchase_cnt:i event_type_signup_cnt:i event_type_view_cnt:i days_since_last_event:i"
)


@query("e19_event_activity", "user_id:i " + ACTIVITY_SPEC, "SELECT * FROM event_activity")
def e19(spark, d):
    return cu.event_activity(event_log(spark, d), FIXTURE_EVENT_TYPES)


view(
    "favourite_share",
    "SELECT user_id, max(cnt) / sum(cnt) AS favorite_category_share FROM (SELECT user_id, category, count(*) AS cnt FROM order_items "
    "WHERE category IS NOT NULL GROUP BY 1, 2) GROUP BY user_id",
)


@query("e21_favourite_share", "user_id:i favorite_category_share:f", "SELECT * FROM favourite_share")
def e21(spark, d):
    return cu.favourite_share(order_items(spark, d, "user_id", "category"))


for _c in ["category", "brand", "gender", "state", "city", "traffic_source"]:
    view(f"sales_mode_{_c}", mode_sql("sales", "user_id", _c))

view(
    "user_table",
    """
WITH u AS (SELECT user_id, min(created_at) AS first_order_at, max(created_at) AS last_order_at, count(DISTINCT order_id) AS orders_cnt,
    sum(num_of_item) AS items_cnt, sum(line_revenue) AS total_revenue, sum(line_profit) AS total_profit, avg(line_revenue) AS avg_order_value,
    avg(num_of_item) AS avg_items_per_line, avg(margin_ratio) AS avg_margin_ratio, avg(is_returned) AS return_rate,
    avg(is_cancelled) AS cancel_rate, avg(delivery_days) AS avg_delivery_days, avg(shipping_delay_days) AS avg_shipping_delay_days,
    avg(discount_ratio) AS discount_ratio_mean, count(DISTINCT category) AS unique_categories, count(DISTINCT product_id) AS unique_products,
    count(DISTINCT brand) AS unique_brands, median(age) AS age, bool_or(is_loyal) AS is_loyal FROM sales GROUP BY user_id),
  s AS (SELECT max(created_at) + INTERVAL 1 DAY AS snapshot_at FROM sales)
SELECT u.*, coalesce(c.category, 'Unknown') AS favorite_category, coalesce(b.brand, 'Unknown') AS favorite_brand,
  coalesce(g.gender, 'Unknown') AS gender, coalesce(st.state, 'Unknown') AS state, coalesce(ci.city, 'Unknown') AS city,
  coalesce(tr.traffic_source, 'Unknown') AS traffic_source,
  floor((epoch_us(snapshot_at) - epoch_us(first_order_at)) / 86400e6) AS customer_tenure_days,
  floor((epoch_us(snapshot_at) - epoch_us(last_order_at)) / 86400e6) AS days_since_last_order,
  orders_cnt / greatest(floor((epoch_us(snapshot_at) - epoch_us(first_order_at)) / 86400e6) / 30, 1) AS purchase_frequency_per_30d,
  f.favorite_category_share
FROM u CROSS JOIN s LEFT JOIN sales_mode_category c USING (user_id) LEFT JOIN sales_mode_brand b USING (user_id)
  LEFT JOIN sales_mode_gender g USING (user_id) LEFT JOIN sales_mode_state st USING (user_id) LEFT JOIN sales_mode_city ci USING (user_id)
  LEFT JOIN sales_mode_traffic_source tr USING (user_id) LEFT JOIN favourite_share f USING (user_id)
""",
)

MART_INPUTS = [
    "order_id", "user_id", "product_id", "category", "brand", "age", "gender", "state", "city", "traffic_source", "is_loyal",
]
USER_SPEC = (
    "user_id:i first_order_at:t last_order_at:t orders_cnt:i items_cnt:i total_revenue:f total_profit:f avg_order_value:f "
    "favorite_category:s favorite_brand:s age:f gender:s state:s traffic_source:s is_loyal:b customer_tenure_days:i "
    "return_rate:f avg_delivery_days:f avg_shipping_delay_days:f unique_categories:i unique_brands:i favorite_category_share:f "
)


@query(
    "e20_customer_mart",
    USER_SPEC
    + "avg_items_per_line:f cancel_rate:f discount_ratio_mean:f city:s days_since_last_order:i purchase_frequency_per_30d:f "
    "recency:i frequency:i monetary:f rfm_score:s rfm_segment:s " + ACTIVITY_SPEC,
    "SELECT u.*, r.recency, r.frequency, r.monetary, r.rfm_score, r.rfm_segment, e.* EXCLUDE (user_id) FROM user_table u "
    "LEFT JOIN rfm_standard r USING (user_id) LEFT JOIN event_activity e USING (user_id)",
)
def e20(spark, d):
    base = sales(spark, d, *MART_INPUTS)
    return cu.customer_mart(base, sg.rfm_segments(base), cu.event_activity(event_log(spark, d), FIXTURE_EVENT_TYPES))


view(
    "user_reviews",
    "SELECT user_id, count(review_text) AS user_review_count, avg(review_word_count) AS user_avg_review_len, "
    "avg(review_negative_flag) AS user_negative_review_rate, avg(review_positive_flag) AS user_positive_review_rate, "
    "avg(review_sentiment_score) AS user_avg_sentiment_score FROM reviewed_sales GROUP BY user_id",
)
REVIEW_SPEC = (
    "user_review_count:i user_avg_review_len:f user_negative_review_rate:f user_positive_review_rate:f user_avg_sentiment_score:f"
)


@query("e23_user_reviews", "user_id:i " + REVIEW_SPEC, "SELECT * FROM user_reviews")
def e23(spark, d):
    return cu.user_review_features(fixture_reviews(order_items(spark, d, "user_id", "customer_review")))


def cluster_mart(spark, d):
    texts = fixture_reviews(order_items(spark, d, "user_id", "customer_review"))
    return cu.cluster_mart(sales(spark, d, *MART_INPUTS), event_log(spark, d), texts)


@query(
    "e25_cluster_mart",
    USER_SPEC
    + "avg_margin_ratio:f unique_products:i recency_days:i purchase_frequency_30d:f events_cnt:i sessions_cnt:i active_days:i "
    "days_since_last_event:i " + REVIEW_SPEC,
    "SELECT u.*, days_since_last_order AS recency_days, purchase_frequency_per_30d AS purchase_frequency_30d, e.events_cnt, "
    "e.unique_sessions AS sessions_cnt, e.active_days, CAST(floor((epoch_us((SELECT max(created_at) + INTERVAL 1 DAY FROM sales)) - "
    "epoch_us(e.last_event_at)) / 86400e6) AS BIGINT) AS days_since_last_event, v.* EXCLUDE (user_id) FROM user_table u "
    "LEFT JOIN event_activity e USING (user_id) LEFT JOIN user_reviews v USING (user_id)",
)
def e25(spark, d):
    return cluster_mart(spark, d)
