"""The panel against a per-snapshot brute force, and its edge rules."""

from __future__ import annotations

import random
import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketry.operators import snapshots as sn

ORDER = (
    "order_id long, user_id long, product_id long, category string, brand string, traffic_source string, gender string, state string, age double, "
    "is_loyal boolean, status string, created_at timestamp, shipped_at timestamp, delivered_at timestamp, returned_at timestamp, num_of_item int, "
    "sale_price double, cost double, customer_review string"
)
EVENT = "user_id long, session_id string, created_at timestamp, event_type string"
DATES = [date(2024, 7, 1), date(2024, 8, 1)]


def line(order, user, at, category="a", age=20.0, returned=False, price=10.0):
    return (order, user, (order or 0) % 5, category, "b", "ads", "F", "S", age, True, "Complete", at, None, None, at if returned else None, 1, price, 4.0, "good")


def build(rows, lines, events=(), **kw):
    events = list(events) or [(999, "s", datetime(2020, 1, 1), "cart")]
    orders = sn.prepare_orders(rows(ORDER, *lines))
    return sn.snapshot_panel(orders, sn.prepare_events(rows(EVENT, *events)), DATES, ["cart", "view"], **kw)


def test_midnight_line_belongs_to_the_future(rows):
    lines = [line(1, 1, datetime(2024, 6, 1)), line(2, 1, datetime(2024, 6, 30, 23, 59)), line(3, 1, datetime(2024, 7, 1))]
    got = {r["snapshot_date"]: r for r in build(rows, lines).collect()}
    july = got[date(2024, 7, 1)]
    assert (july["orders_cnt"], july["future_orders_cnt"], july["churn_target"]) == (2, 1, 0)
    assert (july["recency_days"], july["tenure_days_in_window"]) == (0, 29)
    august = got[date(2024, 8, 1)]
    assert (august["orders_cnt"], august["future_orders_cnt"], august["churn_target"]) == (3, 0, 1)


def test_recent_and_event_columns_are_null_without_rows(rows):
    lines = [line(1, 1, datetime(2024, 2, 1)), line(2, 1, datetime(2024, 2, 2)), line(3, 2, datetime(2024, 6, 29)), line(4, 2, datetime(2024, 6, 30))]
    events = [(2, "s", datetime(2024, 6, 28, 12), "cart")]
    got = {(r["snapshot_date"].month, r["user_id"]): r for r in build(rows, lines, events).collect()}
    old, new = got[(7, 1)], got[(7, 2)]
    assert old["orders_cnt_30d"] is None and old["revenue_90d"] is None and old["return_rate_30d"] is None and old["events_cnt"] is None
    assert (new["orders_cnt_30d"], new["revenue_30d"]) == (2, 20.0)
    assert (new["events_cnt"], new["event_cart_cnt"], new["event_view_cnt"], new["days_since_last_event"]) == (1, 1, 0, 2)
    assert new["favorite_event_type"] == "cart"


def test_history_ignores_later_rows(rows):
    rng = random.Random(3)
    lines = [line(i, rng.randrange(4), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 300)), rng.choice("abc"), rng.choice([20.0, 30.0, 41.0]), rng.random() < 0.3, rng.random() * 9) for i in range(200)]
    whole = build(rows, lines).where(F.col("snapshot_date") == DATES[0])
    cut = build(rows, [x for x in lines if x[11] < datetime(2024, 7, 1)]).where(F.col("snapshot_date") == DATES[0])
    hidden = ["future_orders_cnt", "churn_target"]

    def shown(df):  # float sums may differ in the last digits with the order of addition
        found = {r["user_id"]: r.asDict() for r in df.drop(*hidden).collect()}
        return {u: {k: round(v, 9) if isinstance(v, float) else v for k, v in r.items()} for u, r in found.items()}

    assert shown(whole) == shown(cut) and len(shown(whole)) == 4


def test_panel_equals_brute_force(rows):
    rng = random.Random(5)
    lines = [line(i // 2, rng.randrange(5), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(24 * 320)), rng.choice("abc"), rng.choice([20.0, 30.0, 41.0]), rng.random() < 0.3, rng.random() * 9) for i in range(300)]
    got = {(r["snapshot_date"], r["user_id"]): r for r in build(rows, lines).collect()}
    seen = 0
    for d in DATES:
        s = datetime(d.year, d.month, d.day)
        for user in range(5):
            mine = [x for x in lines if x[1] == user and s - timedelta(days=180) <= x[11] < s]
            orders = {x[0] for x in mine}
            if len(orders) < 2:
                assert (d, user) not in got
                continue
            seen += 1
            r = got[(d, user)]
            ages = sorted(x[8] for x in mine)
            n = len(ages)
            assert r["age"] == (ages[n // 2] if n % 2 else (ages[n // 2 - 1] + ages[n // 2]) / 2)
            assert r["orders_cnt"] == len(orders)
            assert r["total_revenue"] == pytest.approx(sum(x[16] for x in mine))
            assert r["return_rate"] == pytest.approx(sum(x[14] is not None for x in mine) / n)
            counts = {c: sum(x[3] == c for x in mine) for c in "abc"}
            assert r["favorite_category"] == min(counts, key=lambda c: (-counts[c], c))
            recent = [x for x in mine if x[11] >= s - timedelta(days=30)]
            assert r["orders_cnt_30d"] == (len({x[0] for x in recent}) or None)
            future = {x[0] for x in lines if x[1] == user and s <= x[11] < s + timedelta(days=120)}
            assert r["future_orders_cnt"] == len(future)
    assert seen > 5


def test_calendar(rows):
    df = rows("created_at timestamp", (datetime(2023, 1, 5),), (datetime(2024, 6, 30, 5),))
    found = sn.snapshot_dates(df)
    # first: 5 Jan + 180 days = 4 July -> 1 August; last: 30 June - 120 days = 2 March -> 1 March
    assert found[0] == date(2023, 8, 1) and found[-1] == date(2024, 3, 1) and len(found) == 8
    assert sn.snapshot_dates(rows("created_at timestamp", (datetime(2024, 1, 1),))) == []


def test_values_are_shuffled_once_whatever_the_windows(rows):
    """Values are counted by user for all snapshots at once; no shuffle deals copies of them by snapshot and value."""
    lines = [line(i, i % 3, datetime(2024, 6, 1 + i)) for i in range(12)]
    plan = build(rows, lines)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\(([^)]*)\)", plan)
    assert any("_value" in keys for keys in dealt)
    assert not [keys for keys in dealt if "snapshot_date" in keys and ("_value" in keys or "order_id" in keys)]


def test_repeated_and_missing_values_of_a_user(rows):
    day = datetime(2024, 6, 10)
    lines = [line(1, 1, day), line(1, 1, day), line(2, 1, datetime(2024, 5, 1), category=None), line(None, 1, day, category="z"), line(3, 1, datetime(2024, 7, 20))]
    lines = [(*x[:2], 0 if x[0] is None else x[2], *x[3:]) for x in lines]
    got = {r["snapshot_date"].month: r for r in build(rows, lines).collect()}
    assert (got[7]["orders_cnt"], got[7]["orders_cnt_30d"], got[7]["unique_categories"], got[7]["favorite_category"]) == (2, 1, 2, "a")
    assert (got[7]["future_orders_cnt"], got[8]["orders_cnt"], got[8]["future_orders_cnt"]) == (1, 3, 0)
