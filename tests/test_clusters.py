from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector

from basketry.operators import clusters as cl
from basketry.operators import kmeans as km


def test_planted_groups_are_found_and_gaps_are_filled(spark):
    rng = random.Random(1)
    data = []
    for u in range(120):
        g = u % 3
        data.append((u, 100.0 * g + rng.random(), float("inf") if u == 0 else 10.0 * g + rng.random(), None if u % 7 == 0 else g, g, 0.1, 2.0, 5))
    df = spark.createDataFrame(data, "user_id long, total_revenue double, monetary double, recency_days int, orders_cnt int, return_rate double, avg_delivery_days double, events_cnt int")
    out = cl.add_clusters(df, ["total_revenue", "monetary", "missing_column"], k=3, restarts=4)
    found = {}
    for r in out.where("user_id <> 0").collect():  # the filled user lies between two groups
        found.setdefault(r["user_id"] % 3, set()).add(r["cluster"])
    assert all(len(c) == 1 for c in found.values()) and len({c.pop() for c in found.values()}) == 3
    assert out.where("monetary = double('infinity')").count() == 1  # inputs stay as they were
    labels = cl.label_clusters(out)
    assert labels.count() == 3 and labels.agg({"users_cnt": "sum"}).first()[0] == 120
    assert cl.with_cluster_label(out).where("cluster_label IS NULL").isEmpty()
    profile = cl.cluster_profile(out, ["total_revenue"]).collect()
    assert sum(r["users_cnt"] for r in profile) == 120


def plain(x, h, k, restart, seed, rounds=100):
    """The same run in one place."""
    centres = x[[min(range(len(x)), key=lambda i: (-np.log(km._uniform(h[i : i + 1], restart, 0, seed)[0]), h[i]))]]
    while len(centres) < k:
        weight = ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        draw = -np.log(km._uniform(h, restart, len(centres), seed)) / np.maximum(weight, 1e-300)
        centres = np.concatenate((centres, x[[int(np.argmin(np.where(weight > 1e-12, draw, np.inf)))]]))
    for _ in range(rounds):
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        after = np.array([x[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(k)])
        moved, centres = np.sqrt(((after - centres) ** 2).sum(axis=1)).max(), after
        if moved <= 1e-4:
            break
    return ((x[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()


def test_restarts_side_by_side_equal_runs_by_themselves(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 4)) + 3 * rng.integers(0, 4, (300, 1)), 3)
    df = spark.createDataFrame([(int(k), r.tolist()) for k, r in enumerate(x)], "user_id long, x array<double>")
    found = km.fit_restarts(df.repartition(3), 5, 6, 7)
    h = np.array([r.h for r in df.selectExpr("user_id", "xxhash64(user_id, x) AS h").orderBy("user_id").collect()])
    assert found.costs == pytest.approx([plain(x, h, 5, r, 7) for r in range(6)], rel=1e-6)
    best = KMeans(k=5, seed=1, maxIter=100).fit(df.select(array_to_vector("x").alias("features"))).summary.trainingCost
    assert min(found.costs) <= 1.05 * best
    own = {r.user_id: r.cluster for r in found.predict(df).collect()}
    assert all(own[k] == ((r - found.centres) ** 2).sum(axis=1).argmin() for k, r in enumerate(x))


def test_fewer_different_rows_than_clusters(spark):
    df = spark.createDataFrame([(k, [float(k % 2), 0.0]) for k in range(9)], "user_id long, x array<double>")
    found = km.fit_restarts(df, 5, 3, 1)
    assert len(found.centres) == 2 and max(found.costs) == 0.0
    assert len({r.cluster for r in found.predict(df).collect()}) == 2
    assert km.fit_restarts(df.limit(0), 5, 3, 1).costs == []


def test_sums_of_all_restarts_at_once(monkeypatch):
    made = np.random.default_rng(3)
    x, centres = made.normal(size=(5000, 4)), made.normal(size=(6, 3, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64()))], ["x"])
    asked, distances = [], km._distances2
    monkeypatch.setattr(km, "_distances2", lambda rows, c: asked.append((len(rows), len(c))) or distances(rows, c))
    found = next(km._sums(centres)(iter([batch.slice(0, 10), batch.slice(10)])))["sums"][0].as_py()
    assert all(n <= 2048 and c == 18 for n, c in asked) and sum(n for n, _ in asked) == 5000
    far = ((x[:, None, None, :] - centres[None]) ** 2).sum(axis=3)
    own = far.argmin(axis=2)
    counts = np.array([[(own[:, r] == c).sum() for c in range(3)] for r in range(6)])
    sums = np.array([[x[own[:, r] == c].sum(axis=0) for c in range(3)] for r in range(6)])
    assert np.allclose(found, np.concatenate((far.min(axis=2).sum(axis=0), counts.ravel(), sums.ravel())))
