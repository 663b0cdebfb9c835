from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from basketry.operators import cleaning as cl
from basketry.operators import profiling as pf
from basketry.session import stage
from basketry.sources import flatfiles, publish


def test_fills(rows):
    df = rows("k int, s string, x double", (1, "b", 1.0), (2, "a", 3.0), (3, None, None))
    assert [r["s"] for r in cl.fill_mode(df, "s").orderBy("k").collect()] == ["b", "a", "a"]  # a tie takes the smaller
    assert [r["x"] for r in cl.fill_median(df, ["x"]).orderBy("k").collect()] == [1.0, 3.0, 2.0]
    empty = rows("s string", (None,), (None,))
    assert [r["s"] for r in cl.fill_mode(empty, "s").collect()] == [None, None]


def test_winsorise_and_min_max(rows):
    df = rows("x double, c double", *[(float(i), 7.0) for i in range(101)], (None, 7.0))
    out = [r["x"] for r in cl.winsorise(df, ["x"], 0.1, 0.9).collect()]
    assert min(v for v in out if v is not None) == 10.0 and max(v for v in out if v is not None) == 90.0 and out.count(None) == 1
    scaled = cl.min_max(df, ["x", "c"]).collect()
    assert max(r["x"] for r in scaled) == 1.0 and {r["c"] for r in scaled} == {0.0}
    assert scaled[-1]["x"] == 0.0


def test_column_findings(rows):
    df = rows("a long, b string, c string, d string, e long", (1, "x", "x", None, 1), (2, None, None, None, 1), (3, "y", "y", None, 2))
    assert cl.duplicate_columns(df) == {"c": "b"}
    assert cl.empty_columns(df) == ["d"]
    assert cl.identifier_columns(df) == ["a", "b", "c"]
    assert cl.drop_identifier_columns(df).columns == ["d", "e"]
    report = {r["column"]: r["missing_cnt"] for r in pf.missing_report(df).collect()}
    assert report == {"a": 0, "b": 1, "c": 1, "d": 3, "e": 0}


def test_duplicates(rows):
    df = rows("a int, b string", (1, "x"), (1, "x"), (1, None), (1, None), (2, "y"))
    assert tuple(cl.duplicate_summary(df).first()) == (5, 2, 3)


def test_one_hot(rows):
    df = rows("k int, s string", (1, "a"), (2, "a"), (3, "b"), (4, None), (5, "c"))
    out = cl.one_hot_top(df, "s", "s", 2)
    assert [c for c in out.columns if c.startswith("s_")] == ["s_a", "s_b", "s_other"]
    assert [r["s_other"] for r in out.orderBy("k").collect()] == [0, 0, 0, 1, 1]
    assert [c for c in cl.one_hot_top(df, "s", "s", 10).columns if c.startswith("s_")] == ["s_a", "s_b", "s_c", "s_unknown"]


def test_clean_orders(rows):
    raw = rows(
        "order_id long, created_at string, sold_at string, sale_price double, age double, num_of_item int, city string",
        (1, "2024-01-01 00:00:00", None, -5.0, 13.0, 0, " nan"),
        (1, "2024-01-01 00:00:00", None, -5.0, 13.0, 0, " nan"),
        (2, "2024-01-02T00:00:00Z", None, 4.0, 14.0, 2, "Rome "),
        (3, "bad", None, 6.0, 100.0, -1, None),
    )
    out = cl.clean_orders(raw).orderBy("order_id").collect()
    assert "sold_at" not in out[0].asDict()
    assert [(r["sale_price"], r["age"], r["num_of_item"], r["city"]) for r in out] == [(5.0, 57.0, 1, "Unknown"), (4.0, 14.0, 2, "Rome"), (6.0, 100.0, 1, "Unknown")]
    assert out[2]["created_at"] is None


def test_csv_scan_tolerates_missing_columns(spark, tmp_path):
    path = str(tmp_path / "orders")
    spark.createDataFrame([(1, 2, "2024-01-01", 3.5)], "order_id long, user_id long, created_at string, sale_price double").write.option("header", True).csv(path)
    orders = flatfiles.read_orders(spark, path)
    assert orders.columns == flatfiles.ORDER_COLUMNS
    row = orders.first()
    assert (row["order_id"], row["sale_price"], row["brand"]) == (1, 3.5, None)
    assert flatfiles.read_csv(spark, path).columns == ["order_id", "user_id", "created_at", "sale_price"]


def test_publish_and_read(spark, tmp_path):
    df = spark.range(5).withColumn("m", F.col("id") % 2)
    publish.publish_tables({"t": df}, str(tmp_path), partition_by={"t": "m"})
    assert publish.read_published(spark, str(tmp_path), "t").count() == 5
    publish.publish_metrics(df.agg(F.count(F.lit(1)).alias("n")), str(tmp_path))
    assert spark.read.json(str(tmp_path / "metrics")).first()["n"] == 5


def test_stage_refuses_a_cluster_without_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

    from basketry.session import shared_folder

    with pytest.raises(RuntimeError):
        shared_folder(Session())
    assert stage(spark.range(3)).count() == 3


def test_lines_are_compared_once(rows):
    raw = rows("order_id int, age string, sale_price string, city string", (1, "30", "5.0", " a "), (1, "30", "5.0", "a"), (2, None, "-1", "nan"))
    out = cl.clean_orders(raw)
    assert out.inputFiles() and all("different-lines" in f for f in out.inputFiles())
    assert sorted(tuple(r) for r in out.collect()) == [(1, 30.0, 5.0, "a"), (2, 30.0, 5.0, "Unknown")]
