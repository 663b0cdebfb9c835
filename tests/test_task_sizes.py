"""What one task reads, holds or repeats does not grow with the tables."""

from __future__ import annotations

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from basketry import session as se
from basketry.operators import factorization as fz
from basketry.plans import load_catalog


@pytest.mark.parametrize("text, size", [("64MB", 64 << 20), ("16m", 16 << 20), ("1048576b", 1 << 20), ("128", 128), ("1g", 1 << 30)])
def test_size_settings(text, size):
    assert se.size_of(text) == size


def test_tasks_grow_with_the_tables(spark, tmp_path, monkeypatch):
    keys = ["spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    before = {k: spark.conf.get(k, None) for k in keys}
    monkeypatch.setattr(se, "TABLE_BYTES", 100)
    try:
        spark.conf.set(keys[0], "128MB")
        spark.conf.set(keys[1], "1MB")
        found = []
        for rows in (100, 10_000):
            spark.range(rows).write.parquet(f"{tmp_path}/{rows}/lineitem.parquet")
            se.bound_tasks(spark, f"{tmp_path}/{rows}")
            found.append(int(spark.conf.get(keys[2])))
        assert found[0] >= 4 and found[1] > 5 * found[0]
        assert se.size_of(spark.conf.get(keys[0])) == se.SPLIT_BYTES
        assert spark.conf.get(keys[1]) == "1MB"  # smaller ones stay
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffled_by(df, column):
    """Rows that shuffles by ``column`` wrote while ``df`` was collected."""
    df.collect()
    todo, rows = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif kind == "ShuffleExchangeExec" and column in node.outputPartitioning().toString():
            rows += node.metrics().apply("shuffleRecordsWritten").value()
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


@pytest.mark.parametrize("name", ["h06_item_lookup", "h06_item_side"])
def test_items_do_not_shuffle_counts_per_line(spark, tmp_path, monkeypatch, name):
    n, products = 4000, 25
    lines = spark.range(n).selectExpr(
        "id AS l_orderkey", f"id % {products} AS l_partkey", "id % 3 AS l_suppkey", "1 AS l_linenumber", "2.0D AS l_quantity",
        "cast(id AS double) AS l_extendedprice", "0.1D AS l_discount", "0.0D AS l_tax", "if(id % 5 = 0, 'R', 'N') AS l_returnflag",
        "'F' AS l_linestatus", "timestamp_ntz'2001-01-02 00:00:00' AS l_shipdate",
    )
    orders = spark.range(n).selectExpr(
        "id AS o_orderkey", "id AS o_custkey", "'F' AS o_orderstatus", "timestamp_ntz'2001-01-01 00:00:00' AS o_orderdate"
    )
    parts = spark.range(products).selectExpr(
        "id AS p_partkey", "concat('n', id) AS p_name", "concat('b', id % 4) AS p_brand", "concat('t', id % 3) AS p_type", "cast(id AS int) AS p_size"
    )
    for table, df in (("lineitem", lines), ("orders", orders), ("part", parts)):
        df.write.parquet(f"{tmp_path}/{table}.parquet")
    staged = []
    monkeypatch.setattr(fz, "stage", lambda df, label="stage": staged.append(df) or df)
    load_catalog().QUERIES[name](spark, str(tmp_path))
    (items,) = staged
    assert shuffled_by(items, "product_id") < n / 4
    assert {r["item_buyers"] for r in items.select("item_buyers").collect()} == {n // products}


def test_a_staged_table_leaves_no_shuffle_and_can_be_deleted(spark):
    tracked = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    wide = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    before, setting = tracked(), spark.conf.get(key, None)
    table = se.stage(wide, "counts")
    for _ in range(50):  # shuffles are deleted in the background
        if tracked() <= before:
            break
        time.sleep(0.1)
    assert tracked() <= before and spark.conf.get(key, None) == setting
    assert table.count() == 7
    se.discard(table)
    assert not Path(table._staged_at.removeprefix("file:")).exists()
