"""Customer cluster queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import clusters as cl
from basketry.operators import customers as cu
from basketry.operators import segments as sg
from basketry.plans.catalog import query
from basketry.plans.customers_queries import FIXTURE_EVENT_TYPES, MART_INPUTS, cluster_mart, sales
from basketry.session import stage
from basketry.sources.tables import event_log, stamp


_CLUSTERED = {}


def clustered(spark, d):
    """One fit for the queries of a session that show it; another after a table was written again."""
    key = (spark.sparkContext.applicationId, d, stamp(spark, d, ["lineitem", "orders", "customer", "part", "nation", "region", "events", "documents"]))
    if key not in _CLUSTERED:
        _CLUSTERED[key] = stage(cl.add_clusters(cluster_mart(spark, d), cl.FULL_FEATURES), "clustered")
    return _CLUSTERED[key]


@query("f09_clusters", "user_id:i cluster:i total_revenue:f recency_days:i")
def f09(spark, d):
    return clustered(spark, d)


@query("f09_behaviour_clusters", "user_id:i cluster:i recency:i frequency:i monetary:f")
def f09_behaviour(spark, d):
    base = sales(spark, d, *MART_INPUTS)
    mart = cu.customer_mart(base, sg.rfm_segments(base), cu.event_activity(event_log(spark, d), FIXTURE_EVENT_TYPES))
    return cl.add_clusters(mart, cl.BEHAVIOUR_FEATURES)


@query("f10_cluster_profile", "cluster:i users_cnt:i total_revenue:f recency_days:f return_rate:f events_cnt:f")
def f10(spark, d):
    return cl.cluster_profile(clustered(spark, d), cl.FULL_FEATURES)


@query("f11_cluster_labels", "cluster:i users_cnt:i avg_revenue:f avg_orders:f avg_recency:f avg_return_rate:f avg_events:f cluster_label:s")
def f11(spark, d):
    return cl.label_clusters(clustered(spark, d))


@query("f11_labelled_customers", "user_id:i cluster:i cluster_label:s")
def f11_customers(spark, d):
    return cl.with_cluster_label(clustered(spark, d))


# The label rules on groups that SQL can repeat: the traffic source stands in for the cluster.
@query(
    "f11_label_rules",
    "cluster:s users_cnt:i avg_revenue:f avg_orders:f avg_recency:f avg_return_rate:f avg_delivery_days:f avg_events:f cluster_label:s",
    """
WITH m AS (SELECT u.*, traffic_source AS cluster, days_since_last_order AS recency_days, e.events_cnt FROM user_table u LEFT JOIN event_activity e USING (user_id)),
  g AS (SELECT avg(total_revenue) AS gr, avg(return_rate) AS gt, avg(coalesce(events_cnt, 0)) AS ge, avg(orders_cnt) AS go, avg(recency_days) AS ga,
    median(recency_days) AS gm FROM m),
  s AS (SELECT cluster, count(user_id) AS users_cnt, avg(total_revenue) AS avg_revenue, avg(orders_cnt) AS avg_orders, avg(recency_days) AS avg_recency,
    avg(return_rate) AS avg_return_rate, avg(avg_delivery_days) AS avg_delivery_days, avg(events_cnt) AS avg_events FROM m GROUP BY cluster)
SELECT s.*, CASE WHEN avg_revenue >= gr AND avg_recency <= gm THEN 'High Value Active' WHEN avg_return_rate >= gt * 1.1 THEN 'Return Sensitive'
  WHEN avg_events >= ge AND avg_orders <= go THEN 'Engaged Browsers' WHEN avg_recency >= ga * 1.1 THEN 'At Risk Dormant' ELSE 'Core Customers' END AS cluster_label
FROM s, g
""",
)
def f11_rules(spark, d):
    return cl.label_clusters(stage(cluster_mart(spark, d).withColumn("cluster", F.col("traffic_source")), "grouped"))


@query(
    "f10_profile_rules",
    "cluster:s users_cnt:i total_revenue:f recency_days:f return_rate:f events_cnt:f",
    "SELECT traffic_source AS cluster, count(*) AS users_cnt, round(avg(total_revenue), 2) AS total_revenue, round(avg(days_since_last_order), 2) AS recency_days, "
    "round(avg(return_rate), 2) AS return_rate, round(avg(e.events_cnt), 2) AS events_cnt FROM user_table u LEFT JOIN event_activity e USING (user_id) GROUP BY 1",
)
def f10_rules(spark, d):
    """The profile on groups that SQL can repeat, as for the label rules."""
    return cl.cluster_profile(stage(cluster_mart(spark, d).withColumn("cluster", F.col("traffic_source")), "grouped"), cl.FULL_FEATURES)
