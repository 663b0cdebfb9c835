"""Order lines are joined so that the wide rows are shuffled least, with the same rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from basketry.operators import churn as ch
from basketry.plans import cleaning_queries as cq
from basketry.sources import tables

AT = datetime(1996, 5, 1)


def write(spark, folder):
    frames = {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                     "l_returnflag string, l_linestatus string, l_shipdate timestamp",
                     [(o, p, 1, 1, 2.0, 10.0, 0.1, "R", "F", AT) for o, p in [(1, 1), (1, 2), (2, 1), (3, 1), (9, 1), (None, 1), (2, None), (2, 8)]]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp",
                   [(1, 1, "F", AT), (2, 2, "O", AT), (2, 1, "P", AT), (3, 7, "F", AT), (4, None, "F", AT)]),
        "part": ("p_partkey long, p_type string, p_brand string, p_name string, p_size int", [(1, "t", "b", "n", 3), (2, "u", "b", "m", 30), (1, "v", "b", "n", 3)]),
        "customer": ("c_custkey long, c_nationkey long, c_mktsegment string, c_acctbal double", [(1, 1, "m", 1.0), (2, 1, "k", 6000.0)]),
        "nation": ("n_nationkey long, n_name string, n_regionkey long", [(1, "N", 1)]),
        "region": ("r_regionkey long, r_name string", [(1, "R")]),
    }
    for name, (schema, rows) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_customers_are_joined_to_orders_first(spark, tmp_path):
    write(spark, tmp_path)
    lines = tables.order_items(spark, str(tmp_path), "order_id", "user_id", "product_id", "category", "country", "traffic_source")
    got = sorted(tuple(r) for r in lines.collect())
    # order 3 has no customer, order 9, part 8 and missing keys have no partner; order 2 and part 1 are there twice
    assert got == [(1, 1, 1, "t", "R", "m"), (1, 1, 1, "v", "R", "m"), (1, 1, 2, "u", "R", "m"), (2, 1, 1, "t", "R", "m"), (2, 1, 1, "v", "R", "m"),
                   (2, 2, 1, "t", "R", "k"), (2, 2, 1, "v", "R", "k")]
    joins = [x for x in lines._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x]
    place = {key: min(i for i, x in enumerate(joins) if key in x) for key in ("l_orderkey", "o_custkey")}
    assert place["l_orderkey"] < place["o_custkey"]  # the lines' join stands above the customers'


def test_published_tables_join_the_lines_once(spark, tmp_path, monkeypatch):
    write(spark, tmp_path)
    written = []
    real = cq.stage
    monkeypatch.setattr(cq, "stage", lambda df, label="stage": written.append(label) or real(df, label))
    counts = {r["table"]: r["rows"] for r in cq.a04(spark, str(tmp_path)).collect()}
    assert counts == {"customer_features": 2, "churn_predictions": 2, "category_quality": 3, "product_quality": 3}
    assert "lines" in written


def test_passes_have_few_tasks(spark):
    cores = spark.sparkContext.defaultParallelism
    many, few = spark.range(1000).repartition(40 * cores), spark.range(0, 9, 1, 1)
    assert ch.for_passes(many).rdd.getNumPartitions() == ch.PASS_TASKS * cores
    assert ch.for_passes(few).rdd.getNumPartitions() == 1
    assert ch.for_passes(many).agg(F.sum("id")).first()[0] == 499500
