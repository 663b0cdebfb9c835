"""Segmentation queries."""

from __future__ import annotations

from basketry.operators import customers as cu
from basketry.operators import segments as sg
from basketry.plans.catalog import query, view
from basketry.plans.customers_queries import CUSTOMER_INPUTS, customer_features, customer_profile, enriched, sales
from basketry.session import stage

PROFILE_SPEC = (
    "user_id:i orders:i total_spend:f recency_days:i rfm_r:i rfm_f:i rfm_m:i rfm_score:i abc_segment:s xyz_segment:s "
    "event_count:i events_per_session:f customer_segment:s"
)


@query("customer_rfm_abc", PROFILE_SPEC, "SELECT * FROM customer_profile")
def customer_rfm_abc(spark, d):
    return customer_profile(spark, d)


@query("f01_rfm_percentile_scores", "user_id:i rfm_r:i rfm_f:i rfm_m:i rfm_score:i", "SELECT * FROM customer_profile")
def f01(spark, d):
    return sg.add_rfm_scores(customer_features(spark, d))


def _rfm_view(name, rules):
    cases = " ".join(f"WHEN {condition} THEN '{label}'" for label, condition in rules)
    view(
        name,
        f"""
WITH u AS (SELECT user_id, CAST(floor((epoch_us((SELECT max(created_at) + INTERVAL 1 DAY FROM sales)) - epoch_us(max(created_at))) / 86400e6)
    AS BIGINT) AS recency, count(DISTINCT order_id) AS frequency, sum(line_revenue) AS monetary FROM sales GROUP BY user_id),
  r AS (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY recency DESC, user_id) AS rr,
    row_number() OVER (ORDER BY frequency, user_id) AS rf, row_number() OVER (ORDER BY round(monetary, 6), user_id) AS rm FROM u),
  q AS (SELECT *, greatest(1, CAST((5 * (rr - 1) + n - 2) // (n - 1) AS INTEGER)) AS r_score,
    greatest(1, CAST((5 * (rf - 1) + n - 2) // (n - 1) AS INTEGER)) AS f_score,
    greatest(1, CAST((5 * (rm - 1) + n - 2) // (n - 1) AS INTEGER)) AS m_score FROM r)
SELECT user_id, recency, frequency, monetary, r_score, f_score, m_score, r_score::VARCHAR || f_score || m_score AS rfm_score,
  CASE {cases} ELSE 'Regular' END AS rfm_segment FROM q""",
    )


_rfm_view("rfm_standard", sg.RFM_RULES["standard"])
_rfm_view("rfm_strict", sg.RFM_RULES["strict"])
RFM_SPEC = "user_id:i recency:i frequency:i monetary:f r_score:i f_score:i m_score:i rfm_score:s rfm_segment:s"


@query("f02_rfm_segments", RFM_SPEC, "SELECT * FROM rfm_standard")
def f02(spark, d):
    return sg.rfm_segments(sales(spark, d, "user_id", "order_id"))


@query("f02_rfm_segments_strict", RFM_SPEC, "SELECT * FROM rfm_strict")
def f02_strict(spark, d):
    return sg.rfm_segments(sales(spark, d, "user_id", "order_id"), sg.RFM_RULES["strict"])


@query(
    "f03_rfm_summary",
    "rfm_segment:s users_cnt:i avg_recency:f avg_frequency:f avg_monetary:f",
    "SELECT rfm_segment, count(*) AS users_cnt, avg(recency) AS avg_recency, avg(frequency) AS avg_frequency, "
    "avg(monetary) AS avg_monetary FROM rfm_strict GROUP BY rfm_segment",
)
def f03(spark, d):
    return sg.rfm_summary(sg.rfm_segments(sales(spark, d, "user_id", "order_id"), sg.RFM_RULES["strict"]))


@query("f04_customer_abc", "user_id:i abc_segment:s", "SELECT * FROM customer_abc")
def f04(spark, d):
    return sg.customer_abc(customer_features(spark, d))


@query("f05_customer_xyz", "user_id:i xyz_segment:s", "SELECT * FROM customer_xyz")
def f05(spark, d):
    return sg.customer_xyz(enriched(spark, d, "user_id", "order_id"))


view(
    "product_abc",
    """
WITH m AS (SELECT product_id, product_name, category, order_month, sum(line_revenue) AS revenue FROM sales GROUP BY ALL),
  p AS (SELECT product_id, product_name, category, sum(revenue) AS total_revenue, avg(revenue) AS avg_monthly_revenue,
    coalesce(stddev_samp(revenue), 0) AS std_monthly_revenue, count(*) AS months_active FROM m GROUP BY ALL),
  s AS (SELECT *, CASE WHEN avg_monthly_revenue > 0 THEN std_monthly_revenue / avg_monthly_revenue ELSE 0 END AS cv,
    sum(total_revenue) OVER (ORDER BY round(total_revenue, 6) DESC, product_id ROWS UNBOUNDED PRECEDING)
      / sum(total_revenue) OVER () AS cum_share FROM p),
  c AS (SELECT *, CASE WHEN round(cum_share, 9) <= 0.8 THEN 'A' WHEN round(cum_share, 9) <= 0.95 THEN 'B' ELSE 'C' END AS abc_class,
    CASE WHEN round(cv, 9) <= 0.1 THEN 'X' WHEN round(cv, 9) <= 0.25 THEN 'Y' ELSE 'Z' END AS xyz_class FROM s)
SELECT *, abc_class || xyz_class AS abc_xyz_segment FROM c
""",
)


def product_abc(spark, d):
    return sg.product_abc_xyz(sales(spark, d, "product_id", "product_name", "category"))


@query(
    "f06_product_abc_xyz",
    "product_id:i product_name:s category:s total_revenue:f avg_monthly_revenue:f std_monthly_revenue:f months_active:i cv:f "
    "cum_share:f abc_class:s xyz_class:s abc_xyz_segment:s",
    "SELECT * FROM product_abc",
)
def f06(spark, d):
    return product_abc(spark, d)


@query(
    "f07_class_counts",
    "scheme:s class:s products_cnt:i",
    "SELECT 'abc' AS scheme, abc_class AS class, count(*) AS products_cnt FROM product_abc GROUP BY abc_class UNION ALL "
    "SELECT 'xyz', xyz_class, count(*) FROM product_abc GROUP BY xyz_class UNION ALL "
    "SELECT 'abc_xyz', abc_xyz_segment, count(*) FROM product_abc GROUP BY abc_xyz_segment",
)
def f07(spark, d):
    return sg.class_counts(product_abc(spark, d))


@query("f08_named_segments", "user_id:i customer_segment:s", "SELECT user_id, customer_segment FROM customer_profile")
def f08(spark, d):
    lines = enriched(spark, d, *CUSTOMER_INPUTS)
    base = stage(cu.customer_features(lines), "customers")
    return sg.name_segments(sg.add_rfm_scores(base, staged=True).join(sg.customer_abc(base, staged=True), "user_id"))
