"""Hard negatives against plain Python, in blocks and leaves of small size, and their SQL."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from basketry.llm import hard_negatives as H, oracles

SCHEMA = "vec_id long, embedding array<float>, label int, score long, cell int, v string"


def brute(rows, every=100):
    data = []
    for vec_id, x, label, *_ in rows:
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        lab = (label + 1) % 10 if vec_id % 7 == 0 else label
        data.append((vec_id, lab, [math.floor(256 * float(np.float32(c))) for c in x]))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for k, (anchor, lab, v) in enumerate(data):
        if anchor % every:
            continue
        others = [(-dot(v, w), i, m) for n, (i, m, w) in enumerate(data) if n != k]
        for ps, positive, _ in sorted(o for o in others if o[2] == lab)[:5]:
            fits = sorted((s, i) for s, i, m in others if m != lab and 30 * -ps <= 100 * -s <= 90 * -ps)
            out += [(anchor, positive, r + 1, i, -ps, -s) for r, (s, i) in enumerate(fits[:10])]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def clustered(rng, n, width=8):
    centres = rng.normal(size=(6, width))
    return [(int(k), [float(c) for c in np.float32(centres[k % 6] + 0.2 * rng.normal(size=width))], int(rng.integers(0, 10))) for k in range(n)]


@pytest.mark.parametrize("block, leaf, fanout", [(16384, 64, 16), (40, 4, 3)])
def test_equal_to_all_scores(spark, monkeypatch, block, leaf, fanout):
    for name, value in (("BLOCK", block), ("LEAF", leaf), ("FANOUT", fanout), ("CELLS", 5)):
        monkeypatch.setattr(H, name, value)
    rng = np.random.default_rng(5)
    rows = [(*r, 1, 1, "v") for r in clustered(rng, 700)]
    same = [0.5, 0.25, -1.0, 0.0, 0.125, 0.0, 0.0, 1.0]
    rows += [(10_000 + k, same, k % 3, 1, 1, "v") for k in range(300)]  # one vector many times
    odd = [(None, same, 1), (20_001, None, 1), (20_002, same, None), (20_003, [1.0, None], 1), (20_004, [float("nan")] * 8, 1), (20_005, [float("inf")] * 8, 1)]
    odd += [(20_100, [], 3), (20_200, [1.0, 2.0], 3), (20_300, same, 3), (20_300, same, 3), (-100, [-x for x in same], 2), (20_006, [0.0] * 8, 3)]
    rows += [(*r, 1, 1, "v") for r in odd]
    got = H.mine(H.quantised(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert rows_of(got) == brute(rows)


def test_trees_cover_and_bound():
    rng = np.random.default_rng(6)
    x = np.array([r[1] for r in clustered(rng, 500)]) * 256 // 1
    x = np.concatenate((x, np.repeat(x[:1], 200, axis=0))).astype(np.int64)
    most2 = float((x.astype(float) ** 2).sum(axis=1).max())
    points = H._augmented(x, most2)
    order, nodes = H.build(points)
    assert sorted(order) == list(range(700))
    points, x = points[order], x[order]
    q = rng.integers(-300, 300, (20, 8))
    below, above = H.ball_bounds(H._scores(x[nodes["centre"]], q), nodes["radius"], (q.astype(float) ** 2).sum(axis=1), most2)
    scores = x @ q.T
    for k, n in enumerate(nodes):
        own = slice(n["start"], n["end"])
        assert H._distances(points[own], points[n["centre"]]).max() <= n["radius"] + 1e-9
        assert (scores[own] <= above[k]).all() and (scores[own] >= below[k]).all()
        if n["parent"] >= 0:
            up = nodes[n["parent"]]
            assert up["start"] <= n["start"] and n["end"] <= up["end"] and n["parent"] < k
    assert nodes["leaf"].sum() < 400 and nodes["end"][0] == 700


def test_far_cells_are_skipped(spark):
    rng = np.random.default_rng(7)
    tight = [(k, [float(40 * (k % 4 == c)) + float(0.01 * rng.normal()) for c in range(4)], k % 4) for k in range(400)]
    rows = H.numbered(H.quantised(spark.createDataFrame(tight, "vec_id long, embedding array<float>, label int")))
    index = H.CoverIndex(rows)
    wide = {c: (r, n) for c, (r, n) in index.cells.items()}
    query = index.rows.where("vec_id = 100").toPandas()
    q = np.array(query["v"].tolist())
    numbers = sorted(wide)
    _, above = H.ball_bounds(H._scores(index.centres[numbers], q), np.array([wide[c][0] for c in numbers]), (q.astype(float) ** 2).sum(axis=1), index.most2)
    assert (above[:, 0] < 0.5 * (q[0].astype(float) ** 2).sum()).mean() > 0.5


def test_empty_table(spark):
    assert H.mine(H.quantised(spark.createDataFrame([], SCHEMA))).count() == 0


def test_sql_gives_the_same_rows(spark):
    file = "/root/testdata/sf0.01/embeddings.parquet"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{file}'")
    relation = con.execute(oracles.HARD_NEGATIVES)
    names = [c[0] for c in relation.description]
    got = H.mine(H.quantised(spark.read.parquet(file)))
    want = sorted(relation.fetchall())
    assert got.columns == names and len(want) > 100 and rows_of(got) == want
