"""Churn panel, label, model and measure queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from basketry.functions.scalars import attach_row
from basketry.operators import churn as ch
from basketry.operators import metrics as mt
from basketry.operators import snapshots as sn
from basketry.plans.catalog import mode_sql, query, view
from basketry.plans.customers_queries import FIXTURE_EVENT_TYPES, customer_profile
from basketry.plans.derived_queries import FIXTURE_NEGATIVE, FIXTURE_POSITIVE, review_sql
from basketry.session import stage
from basketry.sources.tables import event_log, load, order_items, stamp

PANEL_INPUTS = [
    "order_id", "user_id", "product_id", "category", "brand", "age", "gender", "state", "traffic_source", "is_loyal", "status",
    "created_at", "shipped_at", "delivered_at", "returned_at", "num_of_item", "sale_price", "cost", "customer_review",
]


def prepared(spark, d):
    return sn.prepare_orders(order_items(spark, d, *PANEL_INPUTS)), sn.prepare_events(event_log(spark, d))


view(
    "rule_cuts",
    "SELECT quantile_cont(recency_days, 0.75) AS r75, quantile_cont(orders, 0.35) AS o35, greatest(0.25, quantile_cont(cancel_rate, 0.8)) AS c80, "
    "greatest(0.12, quantile_cont(return_rate, 0.8)) AS t80, quantile_cont(events_per_session, 0.3) AS e30 FROM customer_profile",
)


@query(
    "g01_rule_label",
    "user_id:i churn_label:i",
    "SELECT user_id, CAST((recency_days > r75 AND orders <= o35) OR cancel_rate > c80 OR return_rate > t80 OR "
    "(recency_days > r75 AND events_per_session <= e30) AS INTEGER) AS churn_label FROM customer_profile, rule_cuts",
)
def g01(spark, d):
    return ch.rule_label(stage(customer_profile(spark, d), "profile"))


@query("g02_rule_model", "rows:i positives:i accuracy:f roc_auc:f average_precision:f")
def g02(spark, d):
    return ch.train_rule_model(customer_profile(spark, d)).metrics


@query("g03_rule_predictions", "user_id:i churn_probability:f churn_label:i risk_group:s")
def g03(spark, d):
    return ch.train_rule_model(customer_profile(spark, d)).predictions


@query("g04_coefficient_ranking", "feature:s coefficient:f importance:f")
def g04(spark, d):
    return ch.train_rule_model(customer_profile(spark, d)).importance


# A score that SQL can repeat: the discount plus tax of a line against its return flag.
view(
    "scored_lines",
    "SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, round(l_discount * 5 + l_quantity / 100, 6) AS score FROM lineitem",
)
view(
    "score_counts",
    "SELECT score, sum(label) AS pos, sum(1 - label) AS neg, sum(sum(1 - label)) OVER (ORDER BY score) AS cneg, "
    "sum(sum(label)) OVER (ORDER BY score DESC) AS tp, sum(count(*)) OVER (ORDER BY score DESC) AS pp FROM scored_lines GROUP BY score",
)


def scored_lines(spark, d):
    return load(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.round(F.col("l_discount") * 5 + F.col("l_quantity") / 100, 6).alias("score"),
    )


_METRIC_SQL = (
    "SELECT sum(pos + neg) AS rows, sum(pos) AS positives, sum(CASE WHEN score >= 0.5 THEN pos ELSE neg END) / sum(pos + neg) AS accuracy, "
    "sum(pos * (cneg - neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc, sum(pos * tp / pp) / sum(pos) AS average_precision FROM score_counts"
)


@query("g05_auc_accuracy", "rows:i positives:i accuracy:f roc_auc:f", _METRIC_SQL)
def g05(spark, d):
    return mt.binary_metrics(scored_lines(spark, d), "label", "score")


@query("g19_binary_metrics", "rows:i positives:i accuracy:f roc_auc:f average_precision:f", _METRIC_SQL)
def g19(spark, d):
    return mt.binary_metrics(scored_lines(spark, d), "label", "score")


view(
    "confusion",
    "SELECT a AS actual, p AS predicted, count(s.label) AS \"count\" FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(a, p) "
    "LEFT JOIN scored_lines s ON s.label = a AND CAST(s.score >= 0.5 AS INTEGER) = p GROUP BY a, p",
)


@query("g19_confusion_matrix", "actual:i predicted:i count:i", "SELECT * FROM confusion")
def g19_matrix(spark, d):
    return mt.confusion_matrix(scored_lines(spark, d), "label", "score")


@query(
    "g19_class_report",
    "class:s precision:f recall:f f1:f support:i",
    """
WITH c AS (SELECT k, sum("count") FILTER (actual = k AND predicted = k) / sum("count") FILTER (predicted = k) AS precision,
    sum("count") FILTER (actual = k AND predicted = k) / sum("count") FILTER (actual = k) AS recall, sum("count") FILTER (actual = k) AS support
    FROM confusion, (VALUES (0), (1)) t(k) GROUP BY k),
  f AS (SELECT CAST(k AS VARCHAR) AS class, precision, recall, 2 * precision * recall / (precision + recall) AS f1, support FROM c)
SELECT * FROM f UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f
""",
)
def g19_report(spark, d):
    return mt.class_report(scored_lines(spark, d), "label", "score")


view(
    "panel_lines",
    "SELECT o.*, d.text AS customer_review, sale_price * num_of_item AS line_revenue, (sale_price - cost) * num_of_item AS line_profit, "
    "CASE WHEN sale_price = 0 THEN 0 ELSE (sale_price - cost) / sale_price END AS margin_ratio, CAST(returned_at IS NOT NULL AS INTEGER) AS is_returned, "
    "CAST(status = 'Cancelled' AS INTEGER) AS is_cancelled, CAST(shipped_at IS NOT NULL AS INTEGER) AS is_shipped, "
    "CAST(delivered_at IS NOT NULL AS INTEGER) AS is_delivered, (epoch_us(shipped_at) - epoch_us(created_at)) / 86400e6 AS shipping_delay_days, "
    "(epoch_us(delivered_at) - epoch_us(created_at)) / 86400e6 AS delivery_days, (epoch_us(returned_at) - epoch_us(created_at)) / 86400e6 AS return_days "
    "FROM order_items o LEFT JOIN documents d ON o.order_id = d.doc_id",
)
view("panel_reviewed", review_sql("panel_lines", "* EXCLUDE (customer_review, review_text, review_text_clean, review_char_len, "
     "review_word_count, review_unique_word_count, review_exclamation_count, review_question_count, has_review, positive_word_count, negative_word_count)"))
view(
    "snapshot_calendar",
    "SELECT CAST(s AS DATE) AS snapshot_date FROM (SELECT unnest(generate_series(date_trunc('month', lo + to_days(179)) + to_months(1), "
    "hi - to_days(120), INTERVAL 1 MONTH)) AS s FROM (SELECT date_trunc('day', min(created_at)) AS lo, date_trunc('day', max(created_at)) AS hi FROM order_items)) "
    "ORDER BY s DESC LIMIT 12",
)
view(
    "history_lines",
    "SELECT s.snapshot_date, l.* FROM panel_reviewed l JOIN snapshot_calendar s ON l.created_at >= s.snapshot_date - to_days(180) AND l.created_at < s.snapshot_date",
)
view(
    "history_events",
    "SELECT s.snapshot_date, e.* FROM event_log e JOIN snapshot_calendar s ON e.created_at >= s.snapshot_date - to_days(180) AND e.created_at < s.snapshot_date",
)
for _c in ["category", "brand", "traffic_source", "gender", "state"]:
    view(f"panel_mode_{_c}", mode_sql("history_lines", "snapshot_date, user_id", _c))
view("panel_mode_event_type", mode_sql("history_events", "snapshot_date, user_id", "event_type"))
_DAYS = "CAST(floor((epoch_us(CAST(snapshot_date AS TIMESTAMP)) - epoch_us({})) / 86400e6) AS BIGINT)"
view(
    "panel_events",
    "SELECT e.*, m.event_type AS favorite_event_type, " + _DAYS.format("last_event_at") + " AS days_since_last_event FROM "
    "(SELECT snapshot_date, user_id, count(*) AS events_cnt, count(DISTINCT session_id) AS sessions_cnt, count(DISTINCT CAST(created_at AS DATE)) AS active_days, "
    "max(created_at) AS last_event_at, "
    + ", ".join(f"count(*) FILTER (event_type = '{t}') AS event_{t}_cnt" for t in FIXTURE_EVENT_TYPES)
    + " FROM history_events GROUP BY 1, 2) e LEFT JOIN panel_mode_event_type m USING (snapshot_date, user_id)",
)
view(
    "panel_future",
    "SELECT s.snapshot_date, user_id, count(DISTINCT order_id) AS future_orders_cnt FROM order_items l JOIN snapshot_calendar s "
    "ON l.created_at >= s.snapshot_date AND l.created_at < s.snapshot_date + to_days(120) GROUP BY 1, 2",
)
_RECENT = ", ".join(
    f"count(DISTINCT order_id) FILTER (created_at >= snapshot_date - to_days({n})) AS orders_{n}, sum(line_revenue) FILTER (created_at >= snapshot_date - to_days({n})) "
    f"AS revenue_{n}d, avg(is_returned) FILTER (created_at >= snapshot_date - to_days({n})) AS return_rate_{n}d"
    for n in (30, 90)
)
view(
    "panel",
    f"""
WITH c AS (SELECT snapshot_date, user_id, min(created_at) AS first_order_in_window, max(created_at) AS last_order_in_window,
    count(DISTINCT order_id) AS orders_cnt, sum(num_of_item) AS items_cnt, sum(line_revenue) AS total_revenue, sum(line_profit) AS total_profit,
    avg(line_revenue) AS avg_order_value, avg(num_of_item) AS avg_items_per_order_line, avg(margin_ratio) AS avg_margin_ratio,
    avg(is_returned) AS return_rate, avg(is_cancelled) AS cancel_rate, avg(is_shipped) AS shipped_rate, avg(is_delivered) AS delivered_rate,
    avg(shipping_delay_days) AS avg_shipping_delay_days, avg(delivery_days) AS avg_delivery_days, avg(return_days) AS avg_return_days,
    count(DISTINCT category) AS unique_categories, count(DISTINCT product_id) AS unique_products, count(DISTINCT brand) AS unique_brands,
    median(age) AS age, bool_or(is_loyal) AS is_loyal, count(review_text) AS user_review_count, avg(review_word_count) AS user_avg_review_len,
    avg(review_negative_flag) AS user_negative_review_rate, avg(review_positive_flag) AS user_positive_review_rate,
    avg(review_sentiment_score) AS user_avg_sentiment_score, {_RECENT} FROM history_lines GROUP BY 1, 2)
SELECT c.*, nullif(orders_30, 0) AS orders_cnt_30d, nullif(orders_90, 0) AS orders_cnt_90d, {_DAYS.format("last_order_in_window")} AS recency_days,
  CAST(floor((epoch_us(last_order_in_window) - epoch_us(first_order_in_window)) / 86400e6) AS BIGINT) AS tenure_days_in_window,
  orders_cnt / 6 AS purchase_frequency_30d, g.category AS favorite_category, b.brand AS favorite_brand, t.traffic_source, x.gender, st.state,
  e.* EXCLUDE (snapshot_date, user_id), coalesce(f.future_orders_cnt, 0) AS future_orders_cnt,
  CAST(coalesce(f.future_orders_cnt, 0) = 0 AS INTEGER) AS churn_target
FROM c LEFT JOIN panel_mode_category g USING (snapshot_date, user_id) LEFT JOIN panel_mode_brand b USING (snapshot_date, user_id)
  LEFT JOIN panel_mode_traffic_source t USING (snapshot_date, user_id) LEFT JOIN panel_mode_gender x USING (snapshot_date, user_id)
  LEFT JOIN panel_mode_state st USING (snapshot_date, user_id) LEFT JOIN panel_events e USING (snapshot_date, user_id)
  LEFT JOIN panel_future f USING (snapshot_date, user_id)
WHERE orders_cnt >= 2
""",
)


def panel(spark, d, gap=sn.GAP_DAYS):
    orders, events = prepared(spark, d)
    dates = sn.snapshot_dates(order_items(spark, d, "created_at"), gap=gap)
    out = sn.snapshot_panel(orders, events, dates, FIXTURE_EVENT_TYPES, gap=gap, positive=FIXTURE_POSITIVE, negative=FIXTURE_NEGATIVE)
    return out, dates


@query(
    "g06_prepared_orders",
    "order_id:i user_id:i product_id:i line_revenue:f line_profit:f margin_ratio:f is_returned:i is_cancelled:i is_shipped:i is_delivered:i "
    "shipping_delay_days:f delivery_days:f return_days:f review_length:i",
    "SELECT *, length(coalesce(customer_review, 'Unknown')) AS review_length FROM panel_lines",
)
def g06(spark, d):
    return prepared(spark, d)[0].withColumn("review_length", F.length("customer_review"))


@query(
    "g07_prepared_events",
    "id:i user_id:i created_at:t event_date:d event_type:s",
    "SELECT *, CAST(created_at AS DATE) AS event_date FROM event_log WHERE user_id IS NOT NULL",
)
def g07(spark, d):
    return prepared(spark, d)[1]


@query("g08_snapshot_calendar", "snapshot_date:d", "SELECT * FROM snapshot_calendar")
def g08(spark, d):
    return sn.snapshot_calendar(order_items(spark, d, "created_at"))


_ID = "snapshot_date:d user_id:i "
_G09 = (
    "first_order_in_window:t last_order_in_window:t orders_cnt:i items_cnt:f total_revenue:f total_profit:f avg_order_value:f avg_items_per_order_line:f "
    "avg_margin_ratio:f return_rate:f cancel_rate:f shipped_rate:f delivered_rate:f avg_shipping_delay_days:f avg_delivery_days:f avg_return_days:f "
    "unique_categories:i unique_products:i unique_brands:i favorite_category:s favorite_brand:s traffic_source:s gender:s state:s age:f is_loyal:b "
    "recency_days:i tenure_days_in_window:i purchase_frequency_30d:f "
)
_G10 = "orders_cnt_30d:i revenue_30d:f return_rate_30d:f orders_cnt_90d:i revenue_90d:f return_rate_90d:f "
_G11 = "user_review_count:i user_avg_review_len:f user_negative_review_rate:f user_positive_review_rate:f user_avg_sentiment_score:f "
_G12 = "events_cnt:i sessions_cnt:i active_days:i last_event_at:t favorite_event_type:s " + " ".join(
    f"event_{t}_cnt:i" for t in FIXTURE_EVENT_TYPES
) + " days_since_last_event:i "
_G13 = "future_orders_cnt:i churn_target:i"


def _panel_query(name, spec):
    @query(name, _ID + spec, "SELECT * FROM panel")
    def run(spark, d):
        return panel(spark, d)[0]


_panel_query("g09_snapshot_features", _G09)
_panel_query("g10_recent_windows", _G10)
_panel_query("g11_review_window", _G11)
_panel_query("g12_event_window", _G12)
_panel_query("g13_forward_label", _G13)
_panel_query("g14_snapshot_panel", _G09 + _G10 + _G11 + _G12 + _G13)


def split_panel(spark, d):
    found, dates = panel(spark, d)
    return sn.time_split(found, dates)


view("panel_cut", "SELECT min(snapshot_date) AS cut FROM (SELECT * FROM snapshot_calendar ORDER BY snapshot_date DESC LIMIT 3)")


@query(
    "g15_time_split",
    "snapshot_date:d user_id:i is_train:b",
    "SELECT snapshot_date, user_id, snapshot_date < cut AS is_train FROM panel, panel_cut",
)
def g15(spark, d):
    return split_panel(spark, d)


_FILLED = ["avg_delivery_days", "revenue_30d", "return_rate_90d", "events_cnt", "days_since_last_event"]


@query(
    "g16_filled_features",
    "snapshot_date:d user_id:i favorite_event_type:s " + " ".join(f"{c}:f" for c in _FILLED),
    "SELECT snapshot_date, user_id, coalesce(favorite_event_type, 'Unknown') AS favorite_event_type, "
    + ", ".join(f"coalesce(p.{c}, m.{c}, 0) AS {c}" for c in _FILLED)
    + " FROM panel p, (SELECT "
    + ", ".join(f"median({c}) AS {c}" for c in _FILLED)
    + " FROM panel, panel_cut WHERE snapshot_date < cut) m",
)
def g16(spark, d):
    return sn.fill_features(split_panel(spark, d))


_FITTED: dict[tuple, ch.ChurnResult] = {}


def boosted(spark, d):
    """One fit for the queries of a session that show it; another after a table was written again."""
    key = (spark.sparkContext.applicationId, d, stamp(spark, d, ["lineitem", "orders", "customer", "part", "nation", "region", "events"]))
    if key not in _FITTED:
        _FITTED[key] = ch.train_boosted(stage(sn.fill_features(split_panel(spark, d)), "filled-panel"))
    return _FITTED[key]


_TEXTS = ["favorite_category", "favorite_brand", "traffic_source", "gender", "state", "favorite_event_type"]


def _ordered_sql(c):
    place = "md5(user_id || ':' || strftime(snapshot_date, '%Y-%m-%d') || ':42')"
    earlier = f"OVER (PARTITION BY is_train, {c} ORDER BY {place} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    whole = f"OVER (PARTITION BY {c})"
    return (
        f"CASE WHEN is_train THEN (coalesce(sum(churn_target) {earlier}, 0) + 0.5) / (count(*) {earlier} + 1) "
        f"ELSE (coalesce(sum(churn_target) FILTER (is_train) {whole}, 0) + 0.5) / (count(*) FILTER (is_train) {whole} + 1) END AS {c}_t"
    )


@query(
    "g17_ordered_statistics",
    "snapshot_date:d user_id:i is_train:b " + " ".join(f"{c}_t:f" for c in _TEXTS),
    "WITH p AS (SELECT snapshot_date, user_id, churn_target, snapshot_date < cut AS is_train, "
    + ", ".join(f"coalesce({c}, 'Unknown') AS {c}" for c in _TEXTS)
    + " FROM panel, panel_cut) SELECT snapshot_date, user_id, is_train, "
    + ", ".join(_ordered_sql(c) for c in _TEXTS)
    + " FROM p",
)
def g17_ordered(spark, d):
    """Categories as the mean labels of earlier rows, in the order the boosted model sees them."""
    return ch.encoded_categories(stage(sn.fill_features(split_panel(spark, d)), "filled-panel"))


@query("g17_boosted_churn", "snapshot_date:d user_id:i churn_target:i churn_probability:f")
def g17(spark, d):
    return boosted(spark, d).scored_validation


@query("g18_baseline_churn", "snapshot_date:d user_id:i churn_target:i churn_probability:f")
def g18(spark, d):
    return ch.train_baseline(sn.fill_features(split_panel(spark, d)))


@query("g20_tree_nodes", "tree:i weight:f node:i left:i right:i feature:i value:f rows:i")
def g20_nodes(spark, d):
    """The boosted model's trees as a table."""
    return boosted(spark, d).nodes


@query("g20_feature_importance", "feature:s importance:f")
def g20(spark, d):
    return boosted(spark, d).importance


@query("g21_latest_scores", "snapshot_date:d user_id:i churn_target:i churn_probability:f risk_group:s roc_auc:f average_precision:f")
def g21(spark, d):
    result = boosted(spark, d)
    return attach_row(result.predictions, result.metrics)


@query(
    "g22_dataset_report",
    "rows:i train_rows:i valid_rows:i positive_rate_train:f positive_rate_valid:f latest_snapshot:d",
    "SELECT count(*) AS rows, count(*) FILTER (snapshot_date < cut) AS train_rows, count(*) FILTER (snapshot_date >= cut) AS valid_rows, "
    "avg(churn_target) FILTER (snapshot_date < cut) AS positive_rate_train, avg(churn_target) FILTER (snapshot_date >= cut) AS positive_rate_valid, "
    "max(snapshot_date) AS latest_snapshot FROM panel, panel_cut",
)
def g22(spark, d):
    return sn.dataset_report(split_panel(spark, d))


@query(
    "b24_one_hot_aligned",
    "snapshot_date:d user_id:i category_slots:i active_slots:i",
    # a slot for each level of the train part and one for the others; one slot of either column is set
    "SELECT snapshot_date, user_id, (SELECT count(DISTINCT coalesce(favorite_category, 'Unknown')) + 1 FROM panel, panel_cut WHERE snapshot_date < cut) AS category_slots, "
    "2 AS active_slots FROM panel, panel_cut WHERE snapshot_date >= cut",
)
def b24(spark, d):
    filled = sn.fill_features(split_panel(spark, d))
    encoded = ch.one_hot_aligned(filled.where("is_train"), filled.where("NOT is_train"), ["favorite_category", "favorite_brand"])
    slots = vector_to_array("favorite_category_v")
    total = F.aggregate(F.concat(slots, vector_to_array("favorite_brand_v")), F.lit(0.0), lambda a, x: a + x)
    return encoded.withColumns({"category_slots": F.size(slots), "active_slots": total})
