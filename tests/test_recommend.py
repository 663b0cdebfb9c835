from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketry.operators import factorization as fz
from basketry.operators import rank_eval, recommend as rc

QUALITY = "product_id long, product_name string, category string, brand string, revenue double, items long, return_rate double, cancel_rate double, avg_margin double, quality_risk double"
T0 = datetime(2024, 1, 1)


def quality_rows(n=40):
    return [(p, f"p{p}", "abcd"[p % 4], "b", float(p), 10, 0.0, 0.0, 1.0, 0.0 if p < 30 else 0.9) for p in range(n)]


def test_good_products_and_empty_fallback(rows):
    good = rc.good_products(rows(QUALITY, *quality_rows()))
    assert {r["product_id"] for r in good.collect()} == set(range(30))
    few = rows(QUALITY, *[(*q[:5], 1, *q[6:]) for q in quality_rows()])
    assert rc.good_products(few).count() == 40


def brute_offers(quality, bought, offers):
    order = lambda q: (q[9], -q[4], -q[8], q[0])
    good = sorted([q for q in quality if q[9] <= 0.0], key=order)
    picked = []
    for c in sorted(bought):
        picked += [q for q in good if q[2] == c][:5]
    picked += [q for q in good[:30] if q[2] not in bought][:10]
    out = []
    for q in picked:
        if q[0] not in out:
            out.append(q[0])
    return out[:offers]


@pytest.mark.parametrize("offers", [3, 12])
def test_retention_offers_equal_brute_force(rows, offers):
    bought = {1: {"a"}, 2: {"b", "d"}, 3: set(), 4: {"a", "b", "c", "d"}}
    lines = [(u, c) for u, cs in bought.items() for c in cs for _ in range(3)] + [(3, None), (9, "a")]
    users = rows("user_id long, churn_probability double", *[(u, 0.5) for u in bought])
    got = rc.retention_offers(rows("user_id long, category string", *lines), rows(QUALITY, *quality_rows()), users, offers)
    lists = {u: [] for u in bought}
    for r in got.orderBy("user_id", "rank").collect():
        lists[r["user_id"]].append(r["recommended_product_id"])
    assert lists == {u: brute_offers(quality_rows(), cs, offers) for u, cs in bought.items()}


def test_newest_order_and_split(rows):
    lines = rows(
        "user_id long, order_id long, created_at timestamp, product_id long",
        (1, 11, T0, 1), (1, 12, T0, 2), (2, 21, T0, 1), (3, 31, T0, 1), (3, 32, T0 + timedelta(days=1), 5), (3, 32, T0 - timedelta(days=9), 6),
    )
    train, test = rc.temporal_split(lines)
    # user 1: a tie goes to the smaller order; user 2 has one order and stays in train
    assert sorted((r["user_id"], r["order_id"]) for r in test.collect()) == [(1, 11), (3, 32), (3, 32)]
    assert train.count() == 3


def test_rank_metrics_by_hand(rows):
    recs = rows(
        "user_id long, rank int, recommended_product_id long, category string",
        (1, 1, 10, "a"), (1, 2, 11, "b"), (1, 3, 12, "b"), (2, 1, 20, None), (2, 2, 21, "c"), (3, 1, 30, "a"),
    )
    test = rows("user_id long, product_id long, category string", (1, 11, "b"), (1, 99, "z"), (2, 77, "c"))
    r = rank_eval.rank_metrics(recs, test, 3).first()
    assert r["evaluated_users"] == 2
    assert r["product_hit_rate_at_k"] == 0.5 and r["product_mrr_at_k"] == 0.25
    assert r["product_precision_at_k"] == pytest.approx(1 / 6) and r["product_recall_at_k"] == 0.25
    assert r["category_hit_rate_at_k"] == 1.0 and r["category_mrr_at_k"] == pytest.approx((1 / 2 + 1) / 2)  # missing categories hold no place
    h = rank_eval.holdout_metrics(recs, test, 3).first()
    assert h["category_recall_at_k"] == pytest.approx((2 / 2 + 1) / 2)
    assert h["product_hit_rate_at_1"] == 0.0


def test_coverage(rows):
    recs = rows("user_id long, recommended_product_id long, category string, quality_risk double", (1, 1, "a", 0.0), (1, 2, "a", 0.2), (2, 1, "a", 0.0))
    r = rank_eval.coverage(rows("product_id long, category string", (1, "a"), (2, "b"), (3, "b"), (4, "b")), recs).first()
    assert (r["recommended_rows"], r["recommended_users"], r["unique_recommended_products"]) == (3, 2, 2)
    assert (r["catalog_coverage_product"], r["catalog_coverage_category"], r["median_quality_risk"]) == (0.5, 0.5, 0.0)
    assert (r["min_recommendations_per_user"], r["max_recommendations_per_user"]) == (1, 2)


def test_tiers_take_the_first_that_has_rows(rows):
    shape = "user_id long, rank int, recommended_product_id long, product_name string, category string, brand string, score double, item_quality_risk double, source string"
    first = rows(shape, (1, 1, 5, "p", "c", "b", 1.0, 0.0, "one"), (1, 2, 6, "p", "c", "b", 1.0, 0.0, "one"))
    second = rows(shape, (1, 1, 7, "p", "c", "b", 1.0, 0.0, "two"), (2, 1, 8, "p", "c", "b", 1.0, 0.0, "two"))
    got = sorted((r["user_id"], r["recommended_product_id"], r["source"]) for r in rc.tiered_offers([first, second], 1).collect())
    assert got == [(1, 5, "one"), (2, 8, "two")]
    last = rc.fallback_offers(rows("user_id long, churn_probability double", (1, 0.5), (2, None)), rows(QUALITY, *quality_rows()), 2).collect()
    assert sorted((r["user_id"], r["recommended_product_id"]) for r in last) == [(1, 28), (1, 29), (2, 28), (2, 29)]
    assert {r["user_id"]: round(r["score"], 3) for r in last} == {1: 1.05, 2: 1.0}


def test_factorization_lists(spark, rows):
    # two groups of users and items; user 0 has seen nearly everything in the catalogue
    big = 10_000_000_000
    rng = random.Random(8)
    pairs = [(big + u, 7 * i, 2.0) for u in range(24) for i in range(30) if i % 2 == u % 2 and rng.random() < 0.6] + [(big, 7 * i, 1.0) for i in range(27)]
    pairs = rows("UserId long, ItemId long, Value double", *dict.fromkeys(pairs))
    pairs = pairs.groupBy("UserId", "ItemId").agg(F.max("Value").alias("Value"))
    users = rows("UserId long, even float, odd float", *[(big + u, float(u % 2 == 0), float(u % 2)) for u in range(24)])
    items = rows("ItemId long, even float, odd float", *[(7 * i, float(i % 2 == 0), float(i % 2)) for i in range(30)])
    lookup = rows("ItemId long, product_name string, category string, brand string, item_quality_risk double", *[(7 * i, "p", "even" if i % 2 == 0 else "odd", "b", 0.1) for i in range(30)])
    fitted = fz.fit_factorization(pairs, users, items, rank=4, rounds=5)
    asked = rows("user_id long", *[(big + u,) for u in range(24)], (5,))
    recs = fz.recommend(fitted, pairs, lookup, asked, n=5)
    got = recs.collect()
    assert {r["user_id"] for r in got} == {big + u for u in range(24)}  # the unknown user drops out
    seen = {(r["UserId"], r["ItemId"]) for r in pairs.collect()}
    assert not any((r["user_id"], r["recommended_product_id"]) in seen for r in got)
    per_user = recs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("top")).collect()
    left = {big + u: 30 - sum(s[0] == big + u for s in seen) for u in range(24)}
    assert {r["user_id"]: r["n"] for r in per_user} == {u: min(5, n) for u, n in left.items()}
    best = [r for r in got if r["rank"] == 1 and r["user_id"] != big]
    agree = sum((r["category"] == "even") == ((r["user_id"] - big) % 2 == 0) for r in best)
    assert agree >= 0.9 * len(best)


def test_factorization_lists_need_no_long_lists(rows, monkeypatch):
    # every user has seen other items; the pseudo items of the attributes have the largest scores of all
    pairs = rows("UserId long, ItemId long, Value double", *[(u, i, 1.0 + (u + i) % 3) for u in range(8) for i in range(20) if (u * 7 + i) % 4 == 0], (None, 3, 1.0), (3, None, 1.0))
    users = rows("UserId long, a float, b float", *[(u, 1.0, 1.0) for u in range(8)])
    items = rows("ItemId long, a float", *[(i, 1.0) for i in range(20)])
    lookup = rows("ItemId long, product_name string, category string, brand string, item_quality_risk double", *[(i, f"p{i}", "c", "b", 0.1) for i in range(19)])
    fitted = fz.fit_factorization(pairs, users, items, rank=3, rounds=3)

    def long_lists(*_):
        raise AssertionError("lists with all pseudo and seen items")

    monkeypatch.setattr(type(fitted.model), "recommendForUserSubset", long_lists)
    got = fz.recommend(fitted, pairs, lookup, rows("user_id long", *[(u,) for u in range(8)], (None,), (99,)), n=4).collect()
    u_of, i_of = {r.u: r.UserId for r in fitted.users.collect()}, {r.i: r.ItemId for r in fitted.items.collect()}
    uf = {u_of[r.id]: r.features for r in fitted.model.userFactors.collect() if u_of.get(r.id) is not None}
    vf = {i_of[r.id]: r.features for r in fitted.model.itemFactors.collect() if i_of.get(r.id) is not None}
    seen = {(r.UserId, r.ItemId) for r in pairs.collect()}
    for u, f in uf.items():
        order = sorted((-sum(a * b for a, b in zip(f, g)), i) for i, g in vf.items() if (u, i) not in seen)[:4]
        own = sorted((r["rank"], r.recommended_product_id, r.score, r.product_name) for r in got if r.user_id == u)
        assert [(i, pytest.approx(-s)) for s, i in order] == [(i, s) for _, i, s, _ in own]
        assert all(name == (f"p{i}" if i < 19 else None) for _, i, _, name in own)
    assert {r.user_id for r in got} == set(uf)


def test_offer_targets(rows):
    lines = rows(
        "user_id long, order_id long, product_id long, created_at timestamp, sale_price double, is_cancelled int, is_returned int",
        (1, 1, 1, T0, 5.0, 1, 0), (2, 2, 1, T0 + timedelta(days=10), 5.0, 0, 0), (2, 3, 1, T0 + timedelta(days=10), 5.0, 0, 0), (3, 4, 1, T0, 5.0, 1, 1),
    )
    known = rows("UserId long, ItemId long", (1, 1), (2, 1))
    got = rc.offer_targets(lines, known).collect()
    assert [r["user_id"] for r in got] == [1, 2]
    assert got[0]["score"] == pytest.approx(0.45 + 0.25 + 0.10) and got[1]["score"] == 0.0


def test_users_outside_the_stored_lists_get_the_models_own_offers(spark, monkeypatch):
    from basketry.operators import recommend as rc
    from basketry.plans import recommend_queries as rq

    folder, whole = "/root/testdata/sf0.001", rc.offer_targets
    monkeypatch.setattr(rc, "offer_targets", lambda lines, pairs: whole(lines, pairs, limit=10))
    source = {r.user_id: r.source for r in rq.h15(spark, folder).select("user_id", "source").distinct().collect()}
    known = {r.UserId for r in rq.fitted_model(spark, folder)[0].users.collect()}
    own = {u for u, s in source.items() if s == "hybrid_als"}
    assert sum(s == "hybrid_prebuilt" for s in source.values()) == 10 and len(known) > 10
    assert len(own) == len(known) - 10 and own < known


def test_item_levels_are_counted_one_by_one(rows):
    schema = (
        "product_id int, user_id int, sale_price double, margin double, retail_price double, is_returned int, is_cancelled int, "
        "is_completed int, category string, brand string, department string, product_name string"
    )
    line = lambda p, u, *levels: (p, u, 2.0, 1.0, 4.0, 0, 0, 1, *levels)
    lines = rows(
        schema, line(1, 7, "a", "x", "d", None), line(1, 7, "a", "y", "c", None), line(1, 8, "b", "y", "c", None), line(1, None, "b", "z", None, None),
        line(2, None, None, "q", "d", "n"), line(2, None, None, "q", "d", "n"),
    )
    found = {r["product_id"]: r for r in fz.item_table(lines).collect()}
    assert [found[1][c] for c in ("category", "brand", "department", "product_name")] == ["a", "y", "c", "unknown"]
    assert [found[2][c] for c in ("category", "brand", "department", "product_name")] == ["unknown", "q", "d", "n"]
    assert [(found[p]["item_sales"], found[p]["item_buyers"], found[p]["item_revenue"]) for p in (1, 2)] == [(4, 2, 8.0), (2, 0, 4.0)]
