"""Global ranks, running sums and quantiles against brute force, heavy ties included."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.functions import ordering as od


def skewed(n, seed=1):
    """A third of the rows share one value."""
    rng = random.Random(seed)
    return [(i, 5.0 if rng.random() < 0.34 else round(rng.uniform(0, 10), 2)) for i in range(n)]


@pytest.mark.parametrize("descending", [False, True])
def test_running_equals_one_window(spark, descending):
    data = skewed(700)
    random.Random(2).shuffle(data)
    df = spark.createDataFrame(data, "id long, v double")
    got = {r["id"]: r for r in od.running(df, "v", "id", sums=["v"], descending=descending).collect()}
    total, cum = sum(v for _, v in data), 0.0
    for rank, (key, v) in enumerate(sorted(data, key=lambda x: (-x[1] if descending else x[1], x[0])), 1):
        cum += v
        assert got[key]["row_rank"] == rank
        assert got[key]["row_total"] == len(data)
        assert got[key]["cum_v"] == pytest.approx(cum)
        assert got[key]["total_v"] == pytest.approx(total)


def test_heavy_value_is_split_into_parts(spark):
    df = spark.createDataFrame([(i, 1.0 if i % 3 else float(i)) for i in range(3000)], "id long, v double")
    cuts, ties = od.cut_points(df, ["v", "id"], 8)
    bucket, part = od.order_bucket(F.col("v"), F.col("id"), cuts, ties)
    sizes = [r["count"] for r in df.groupBy(bucket.alias("b"), part.alias("p")).count().collect()]
    assert max(sizes) < 3000 / 3


@pytest.mark.parametrize("n", [1, 2, 5, 7, 40, 333])
def test_scores_equal_the_formulas(spark, n):
    data = skewed(n, seed=n)
    df = od.stage(spark.createDataFrame(data, "id long, v double"))
    scored = od.add_scores(
        df,
        "id",
        [
            od.Score("up", "v", od.percentile_score_ends),
            od.Score("rev", "v", od.reversed_percentile_score_ends),
            od.Score("q", "v", od.quintile_ends),
            od.Score("qd", "v", od.quintile_ends, descending=True),
        ],
    )
    got = {r["id"]: r for r in scored.collect()}
    for r, (key, _) in enumerate(sorted(data, key=lambda x: (x[1], x[0])), 1):
        assert got[key]["up"] == min(5, max(1, -(-5 * r // n)))
        assert 6 - got[key]["rev"] == min(5, max(1, -(-5 * (n - r) // n)))
        if n > 1:
            assert got[key]["q"] == max(1, -(-5 * (r - 1) // (n - 1)))
    for r, (key, _) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])), 1):
        if n > 1:
            assert got[key]["qd"] == max(1, -(-5 * (r - 1) // (n - 1)))


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_quantiles_are_exact(spark, limit):
    data = skewed(501)
    df = spark.createDataFrame([(v, None if i % 4 else float(i), None) for i, v in data], "a double, b double, c double")
    probabilities = [0.0, 0.01, 0.3, 0.5, 0.99, 1.0]
    row = od.quantiles(df, ["a", "b", "c"], probabilities, limit).first()
    assert row["a"] == pytest.approx(list(np.quantile([v for _, v in data], probabilities)))
    assert row["b"] == pytest.approx(list(np.quantile([i for i, _ in data if i % 4 == 0], probabilities)))
    assert row["c"] is None


def test_result_does_not_depend_on_partitions(spark):
    df = spark.createDataFrame(skewed(300), "id long, v double")
    results = []
    for parts in (1, 17):
        out = od.running(df.repartition(parts), "v", "id", sums=["v"])
        results.append(sorted((r["id"], r["row_rank"], round(r["cum_v"], 6)) for r in out.collect()))
    assert results[0] == results[1]


@pytest.mark.parametrize("size", [0, 1, 5, 16, 17, 32, 100])
def test_count_below_is_the_number_of_smaller_cuts(spark, size):
    cuts = [float(3 * i) for i in range(size)]
    df = spark.createDataFrame([(float(x) / 2,) for x in range(-4, 620)], "v double")
    for r in df.withColumn("n", od.count_below(F.col("v"), cuts)).collect():
        assert r["n"] == sum(c < r["v"] for c in cuts)


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(od, "bucket_count", lambda df: 128)
    data = skewed(900, seed=9)
    df = od.stage(spark.createDataFrame(data, "id long, v double"))
    scored = od.add_scores(df, "id", [od.Score("a", "v", od.quintile_ends), od.Score("b", "v", od.quintile_ends, descending=True), od.Score("c", "v", od.percentile_score_ends)])
    got = {r["id"]: r for r in scored.collect()}
    for r, (key, _) in enumerate(sorted(data, key=lambda x: (x[1], x[0])), 1):
        assert got[key]["a"] == max(1, -(-5 * (r - 1) // 899)) and got[key]["c"] == -(-5 * r // 900)
    row = od.quantiles(df, ["v"], [0.25, 0.5], limit=0).first()
    assert row["v"] == pytest.approx(list(np.quantile([v for _, v in data], [0.25, 0.5])))
