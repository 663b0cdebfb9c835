from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from basketry.operators import customers as cu
from basketry.operators import derive, products, sales
from basketry.operators import segments as sg

T0 = datetime(2024, 1, 1)
SCHEMA = (
    "order_id long, user_id long, product_id long, status string, created_at timestamp, shipped_at timestamp, delivered_at timestamp, "
    "returned_at timestamp, sale_price double, cost double, age double, gender string, country string, city string, traffic_source string, "
    "category string, is_loyal boolean"
)


def line(order, user, day=0, price=10.0, status="Complete", returned=None, gender="F", age=30.0, category="c", product=1, dated=True):
    at = T0 + timedelta(days=day) if dated else None
    return (order, user, product, status, at, None, None, returned, price, 4.0, age, gender, "X", "Y", "ads", category, False)


@pytest.fixture
def lines(rows):
    return derive.enrich_orders(
        rows(
            SCHEMA,
            line(1, 1, 0, gender=None),
            line(1, 1, 0, gender=None, status="Cancelled", dated=False),
            line(2, 2, 3, gender="M", product=2),
            line(2, 2, 3, gender="F", category=None),
            line(3, 2, 40, returned=T0),
        )
    )


def test_undated_line_counts_as_newest(lines):
    got = {r["order_id"]: r for r in cu.latest_order_lines(lines).collect()}
    assert got[1]["is_cancelled"] == 1 and got[1]["created_at"] is None
    assert got[2]["is_cancelled"] == 0


def test_customer_features(lines):
    got = {r["user_id"]: r for r in cu.customer_features(lines).collect()}
    assert got[1]["gender"] == "unknown" and got[1]["orders"] == 1 and got[1]["cancelled_orders"] == 1
    assert got[2]["gender"] == "F" and got[2]["unique_categories"] == 1 and got[2]["unique_products"] == 2
    assert (got[2]["recency_days"], got[2]["tenure_days"], got[2]["orders"]) == (1, 37, 2)
    assert got[2]["return_rate"] == pytest.approx(1 / 3) and got[2]["avg_order_value"] == 15.0
    assert got[2]["purchase_frequency"] == pytest.approx(2 / 38)


def test_xyz_single_month_is_x(lines):
    assert {r["user_id"]: r["xyz_segment"] for r in sg.customer_xyz(lines).collect()} == {1: "X", 2: "X"}


def test_abc_covers_everyone(rows):
    df = rows("user_id long, total_spend double", *[(i, float(100 - i)) for i in range(60)])
    got = {r["user_id"]: r["abc_segment"] for r in sg.customer_abc(df).collect()}
    total, cum = sum(100 - i for i in range(60)), 0
    for i in range(60):
        cum += 100 - i
        assert got[i] == ("A" if cum / total <= 0.8 else "B" if cum / total <= 0.95 else "C")


def test_event_features_keep_roles_and_zeroes(rows):
    events = rows(
        "id long, user_id long, session_id string, event_type string, browser string, created_at timestamp",
        (1, 1, "a", "cart", "b0", T0), (2, 1, "a", "purchase", "b1", T0), (3, 1, "b", None, "b1", T0), (4, None, "z", "cart", "b0", T0),
    )
    r = cu.event_features(events).first()
    assert (r["event_count"], r["sessions"], r["event_cart"], r["event_product"]) == (3, 2, 1, 0)
    assert (r["cart_to_purchase_rate"], r["events_per_session"]) == (1.0, 1.5)
    joined = cu.join_event_features(rows("user_id long", (1,), (9,)), cu.event_features(events)).where("user_id = 9").first()
    assert joined["event_count"] == 0 and joined["last_event"] is None
    a = cu.event_activity(events, ["cart", "view"]).first()
    assert (a["events_cnt"], a["unique_sessions"], a["active_days"], a["favorite_browser"], a["event_type_view_cnt"]) == (3, 2, 1, "b1", 0)
    assert a["favorite_event_type"] == "cart"


def test_rfm_segments_and_rules(rows):
    sales_rows = rows("user_id long, order_id long, created_at timestamp, line_revenue double", *[(u, u * 10 + o, T0 + timedelta(days=u), 5.0) for u in range(1, 8) for o in range(u)])
    got = {r["user_id"]: r for r in sg.rfm_segments(sales_rows).collect()}
    assert got[7]["rfm_score"] == "555" and got[7]["rfm_segment"] == "Champions"
    assert got[1]["rfm_score"] == "111" and got[1]["rfm_segment"] == "Hibernating"
    assert [got[u]["r_score"] for u in range(1, 8)] == [1, 1, 2, 3, 4, 5, 5]


def test_product_risk_uses_median_for_missing_delivery(rows):
    df = rows(
        "product_id long, product_name string, category string, order_id long, line_revenue double, is_returned int, review_negative_flag int, delivery_days double",
        (1, "a", "x", 1, 1.0, 1, 0, 2.0), (2, "b", "x", 2, 1.0, 0, 1, 4.0), (3, "c", "x", 3, 1.0, 0, 0, None),
    )
    got = {r["product_id"]: r["quality_risk_score"] for r in products.product_risk(df).collect()}
    assert got == {1: pytest.approx(0.5 + 0.1), 2: pytest.approx(0.3 + 0.2), 3: pytest.approx(0.2 * 3 / 4)}


def test_calendar_is_filled_and_weeks_end_on_sunday(rows):
    lines = rows(
        "order_id long, status string, created_at timestamp, sale_price double",
        (1, "Complete", datetime(2024, 1, 5, 9), 2.0), (2, "Cancelled", datetime(2024, 1, 6), 9.0), (3, None, datetime(2024, 1, 8), 3.0),
    )
    days = sales.full_calendar(sales.sold_days(lines))
    assert [(str(r["date"]), r["items"]) for r in days.orderBy("date").collect()] == [("2024-01-05", 1), ("2024-01-06", 0), ("2024-01-07", 0), ("2024-01-08", 1)]
    weeks = sales.resample(days, "week").orderBy("date").collect()
    assert [(str(r["date"]), r["revenue"]) for r in weeks] == [("2024-01-07", 2.0), ("2024-01-14", 3.0)]


def test_age_groups_all_appear(rows):
    df = rows("user_id long, line_revenue double, is_returned int, sale_price double, delivery_days double, num_of_item int, line_profit double, order_id long, age_group string", (1, 5.0, 0, 5.0, 1.0, 1, 1.0, 1, "25-34"))
    got = {r["age_group"]: r["users_cnt"] for r in sales.age_sales(df).collect()}
    assert len(got) == 6 and got["25-34"] == 1 and sum(got.values()) == 1
    assert sales.age_sales(df.where(F.lit(False))).count() == 6
