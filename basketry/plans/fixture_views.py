"""SQL views that the query texts share: the canonical tables and their derivations."""

from __future__ import annotations

from basketry.plans.catalog import mode_sql, view

view(
    "order_items",
    """
SELECT l_orderkey AS order_id, o_custkey AS user_id, l_partkey AS product_id, l_suppkey AS distribution_center_id,
  CASE o_orderstatus WHEN 'F' THEN 'Complete' WHEN 'O' THEN 'Shipped' ELSE 'Cancelled' END AS status,
  CAST(o_orderdate AS TIMESTAMP) AS created_at, CAST(l_shipdate AS TIMESTAMP) AS shipped_at,
  CASE WHEN l_linestatus = 'F' THEN CAST(l_shipdate AS TIMESTAMP) + to_days(CAST(l_linenumber AS INTEGER)) END AS delivered_at,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_shipdate AS TIMESTAMP) + to_days(14) END AS returned_at,
  CAST(l_quantity AS INTEGER) AS num_of_item, l_extendedprice / l_quantity AS retail_price,
  l_extendedprice * (1 - l_discount) / l_quantity AS sale_price, 0.6::DOUBLE * l_extendedprice / l_quantity AS cost,
  p_type AS category, p_brand AS brand, p_name AS product_name,
  CASE WHEN p_size <= 25 THEN 'Women' ELSE 'Men' END AS department,
  r_name AS country, n_name AS state, n_name || '-' || CAST(c_custkey % 10 AS VARCHAR) AS city,
  c_mktsegment AS traffic_source, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
  CAST(10 + c_custkey % 95 AS DOUBLE) AS age, c_acctbal > 5000 AS is_loyal
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""",
)

view(
    "event_log",
    """
SELECT event_id AS id, user_id, CAST(user_id AS VARCHAR) || '-' || strftime(ts, '%Y-%m-%d') AS session_id,
  ts - to_years(23) AS created_at, event_type, 'b' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS VARCHAR) AS browser,
  '/' || event_type AS uri, value
FROM events
""",
)

view(
    "enriched",
    """
SELECT *, sale_price - cost AS margin, CAST(returned_at IS NOT NULL AS INTEGER) AS is_returned,
  CAST(status = 'Cancelled' AS INTEGER) AS is_cancelled, CAST(status = 'Complete' AS INTEGER) AS is_completed,
  CAST(status = 'Shipped' AS INTEGER) AS is_shipped,
  (epoch_us(shipped_at) - epoch_us(created_at)) / 86400e6 AS shipping_days,
  (epoch_us(delivered_at) - epoch_us(created_at)) / 86400e6 AS delivery_days
FROM order_items
""",
)

view(
    "sales_base",
    """
SELECT *, CAST(created_at AS DATE) AS order_date, strftime(created_at, '%Y-%m') AS order_month,
  sale_price * num_of_item AS line_revenue, cost * num_of_item AS line_cost,
  sale_price * num_of_item - cost * num_of_item AS line_profit,
  CASE WHEN retail_price > 0 THEN 1 - sale_price / retail_price ELSE 0 END AS discount_ratio,
  CAST(returned_at IS NOT NULL AS INTEGER) AS is_returned, CAST(shipped_at IS NOT NULL AS INTEGER) AS is_shipped,
  CAST(delivered_at IS NOT NULL AS INTEGER) AS is_delivered, CAST(lower(status) LIKE '%cancel%' AS INTEGER) AS is_cancelled,
  (epoch_us(shipped_at) - epoch_us(created_at)) / 86400e6 AS raw_shipping,
  (epoch_us(delivered_at) - epoch_us(created_at)) / 86400e6 AS raw_delivery,
  (epoch_us(returned_at) - epoch_us(created_at)) / 86400e6 AS raw_return,
  (epoch_us(delivered_at) - epoch_us(shipped_at)) / 86400e6 AS raw_gap
FROM order_items
""",
)

view(
    "sales",
    """
SELECT *, CASE WHEN line_revenue > 0 THEN line_profit / line_revenue END AS margin_ratio,
  CASE WHEN raw_shipping >= 0 THEN raw_shipping END AS shipping_delay_days,
  CASE WHEN raw_delivery >= 0 THEN raw_delivery END AS delivery_days,
  CASE WHEN raw_return >= 0 THEN raw_return END AS return_days,
  CASE WHEN raw_gap >= 0 THEN raw_gap END AS delivery_gap_days
FROM sales_base
""",
)

view(
    "order_level",
    """
SELECT user_id, order_id, created_at, is_cancelled, is_completed FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, order_id
    ORDER BY created_at DESC NULLS FIRST, is_cancelled DESC, is_completed DESC) AS pos FROM enriched) WHERE pos = 1
""",
)

for _c in ["gender", "country", "city", "traffic_source"]:
    view(f"mode_{_c}", mode_sql("enriched", "user_id", _c))

view(
    "customer_base",
    """
WITH c AS (SELECT user_id, count(*) AS items, coalesce(sum(sale_price), 0) AS total_spend, coalesce(sum(margin), 0) AS total_margin,
    count(DISTINCT product_id) AS unique_products, count(DISTINCT category) AS unique_categories,
    avg(sale_price) AS avg_item_price, sum(is_returned) AS returned_items, sum(is_cancelled) AS cancelled_items,
    sum(is_completed) AS completed_items, sum(is_shipped) AS shipped_items, avg(shipping_days) AS avg_shipping_days,
    avg(delivery_days) AS avg_delivery_days, median(age) AS age, bool_or(is_loyal) AS is_loyal,
    min(created_at) AS first_order, max(created_at) AS last_order FROM enriched GROUP BY user_id),
  o AS (SELECT user_id, count(DISTINCT order_id) AS orders, sum(is_cancelled) AS cancelled_orders,
    sum(is_completed) AS completed_orders FROM order_level GROUP BY user_id),
  r AS (SELECT max(created_at) + INTERVAL 1 DAY AS reference_date FROM enriched)
SELECT c.*, coalesce(g.gender, 'unknown') AS gender, coalesce(k.country, 'unknown') AS country, coalesce(t.city, 'unknown') AS city,
  coalesce(f.traffic_source, 'unknown') AS traffic_source, o.orders, o.cancelled_orders, o.completed_orders,
  c.total_spend / o.orders AS avg_order_value, c.returned_items / c.items AS return_rate, c.cancelled_items / c.items AS cancel_rate,
  c.completed_items / c.items AS completion_rate,
  CAST(floor((epoch_us(reference_date) - epoch_us(last_order)) / 86400e6) AS BIGINT) AS recency_days,
  CAST(greatest(floor((epoch_us(last_order) - epoch_us(first_order)) / 86400e6), 0) AS BIGINT) AS tenure_days,
  o.orders / (greatest(floor((epoch_us(last_order) - epoch_us(first_order)) / 86400e6), 0) + 1) AS purchase_frequency
FROM c JOIN o USING (user_id) CROSS JOIN r LEFT JOIN mode_gender g USING (user_id) LEFT JOIN mode_country k USING (user_id)
  LEFT JOIN mode_city t USING (user_id) LEFT JOIN mode_traffic_source f USING (user_id)
""",
)

view(
    "customer_scores",
    """
SELECT *, greatest(1, least(5, CAST(floor((5 * (n - rr) + n - 1) / n) AS INTEGER))) AS rfm_r,
  least(5, CAST(floor((5 * rf + n - 1) / n) AS INTEGER)) AS rfm_f, least(5, CAST(floor((5 * rm + n - 1) / n) AS INTEGER)) AS rfm_m
FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY recency_days, user_id) AS rr,
  row_number() OVER (ORDER BY orders, user_id) AS rf, row_number() OVER (ORDER BY round(total_spend, 6), user_id) AS rm FROM customer_base)
""",
)

view(
    "customer_abc",
    """
SELECT user_id, CASE WHEN share <= 0.80 THEN 'A' WHEN share <= 0.95 THEN 'B' ELSE 'C' END AS abc_segment FROM (
  SELECT user_id, round(sum(total_spend) OVER (ORDER BY round(total_spend, 6) DESC, user_id ROWS UNBOUNDED PRECEDING)
    / greatest(sum(total_spend) OVER (), 1), 9) AS share FROM customer_base)
""",
)

view(
    "customer_xyz",
    """
SELECT user_id, CASE WHEN cv <= 0.5 THEN 'X' WHEN cv <= 1.0 THEN 'Y' ELSE 'Z' END AS xyz_segment FROM (
  SELECT user_id, round(coalesce(coalesce(stddev_samp(monthly_orders), 0) / nullif(avg(monthly_orders), 0), 0), 9) AS cv FROM (
    SELECT user_id, strftime(created_at, '%Y-%m') AS month, count(*) AS monthly_orders FROM order_level GROUP BY 1, 2) GROUP BY user_id)
""",
)

view(
    "event_features",
    """
SELECT user_id, count(*) AS event_count, count(DISTINCT session_id) AS sessions, min(created_at) AS first_event,
  max(created_at) AS last_event, count(*) FILTER (event_type = 'click') AS event_cart,
  count(*) FILTER (event_type = 'purchase') AS event_purchase, count(*) FILTER (event_type = 'error') AS event_cancel,
  count(*) FILTER (event_type = 'view') AS event_product, count(*) FILTER (event_type = 'signup') AS event_department,
  coalesce(count(*) / nullif(count(DISTINCT session_id), 0), 0) AS events_per_session,
  coalesce(count(*) FILTER (event_type = 'purchase') / nullif(count(*) FILTER (event_type = 'click'), 0), 0) AS cart_to_purchase_rate,
  count(*) FILTER (event_type = 'error') / count(*) AS cancel_event_rate
FROM event_log WHERE user_id IS NOT NULL GROUP BY user_id
""",
)

view(
    "customer_profile",
    """
SELECT s.*, s.rfm_r * 100 + s.rfm_f * 10 + s.rfm_m AS rfm_score, a.abc_segment, x.xyz_segment,
  coalesce(e.event_count, 0) AS event_count, coalesce(e.sessions, 0) AS sessions, coalesce(e.event_cart, 0) AS event_cart,
  coalesce(e.event_purchase, 0) AS event_purchase, coalesce(e.event_cancel, 0) AS event_cancel,
  coalesce(e.event_product, 0) AS event_product, coalesce(e.event_department, 0) AS event_department,
  coalesce(e.events_per_session, 0) AS events_per_session, coalesce(e.cart_to_purchase_rate, 0) AS cart_to_purchase_rate,
  coalesce(e.cancel_event_rate, 0) AS cancel_event_rate, e.first_event, e.last_event,
  CASE WHEN a.abc_segment = 'A' AND rfm_f >= 4 AND rfm_m >= 4 THEN 'champions' WHEN rfm_r <= 2 AND rfm_m >= 4 THEN 'valuable_sleeping'
    WHEN rfm_f >= 4 AND rfm_m <= 3 THEN 'frequent_value_seekers' WHEN cancel_rate > 0.25 OR return_rate > 0.15 THEN 'service_risk'
    WHEN orders <= 1 THEN 'new_or_one_time' ELSE 'regular' END || '_' || rfm_r || rfm_f || rfm_m AS customer_segment
FROM customer_scores s JOIN customer_abc a USING (user_id) JOIN customer_xyz x USING (user_id) LEFT JOIN event_features e USING (user_id)
""",
)

view(
    "product_quality",
    """
SELECT product_id, product_name, category, brand, coalesce(sum(sale_price), 0) AS revenue, count(*) AS items, avg(is_returned) AS return_rate,
  avg(is_cancelled) AS cancel_rate, avg(margin) AS avg_margin, avg(is_returned) * 0.55 + avg(is_cancelled) * 0.45 AS quality_risk
FROM enriched WHERE product_id IS NOT NULL AND product_name IS NOT NULL AND category IS NOT NULL AND brand IS NOT NULL GROUP BY ALL
""",
)
