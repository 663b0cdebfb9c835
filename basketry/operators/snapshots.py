"""Point-in-time customer panel: features before each snapshot, orders after it.

All snapshots are built in one job. Lines are first summed by (user, day), and their values
counted by (user, value) for all snapshots at once; only these small rows are copied to the
snapshots whose window holds them (at most the number of snapshots), so no range join and no
per-snapshot pass is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.grouping import distinct_in, mode_in
from basketry.functions.ordering import medians
from basketry.functions.scalars import clip, parse_timestamp, to_number, total, whole_days
from basketry.functions.text import NEGATIVE_WORDS, POSITIVE_WORDS, review_features
from basketry.operators.derive import durations, unit_margin_ratio
from basketry.session import stage

WINDOW_DAYS = 180
GAP_DAYS = 120
KEYS = ["snapshot_date", "user_id"]


def prepare_orders(lines: DataFrame) -> DataFrame:
    """Order lines typed and derived for the panel; lines without user or time are dropped."""
    times = {c: parse_timestamp(F.col(c)) if dict(lines.dtypes)[c] == "string" else F.col(c) for c in ["created_at", "returned_at", "shipped_at", "delivered_at"]}
    number = to_number(F.col("num_of_item"), 1.0) if "num_of_item" in lines.columns else F.lit(1.0)
    review = F.coalesce(F.col("customer_review"), F.lit("Unknown")) if "customer_review" in lines.columns else F.lit("Unknown")
    out = lines.withColumns(
        {
            **times,
            "sale_price": to_number(F.col("sale_price"), 0.0),
            "cost": to_number(F.col("cost"), 0.0),
            "num_of_item": number,
            "customer_review": review,
        }
    ).na.drop(subset=["user_id", "created_at"])
    out = unit_margin_ratio(durations(out))
    n, price, cost = F.col("num_of_item"), F.col("sale_price"), F.col("cost")
    return out.withColumns(
        {
            "line_revenue": price * n,
            "line_profit": (price - cost) * n,
            "is_returned": F.col("returned_at").isNotNull().cast("int"),
            "is_cancelled": F.coalesce(F.col("status") == "Cancelled", F.lit(False)).cast("int"),
            "is_shipped": F.col("shipped_at").isNotNull().cast("int"),
            "is_delivered": F.col("delivered_at").isNotNull().cast("int"),
        }
    )


def prepare_events(events: DataFrame) -> DataFrame:
    """Events with a numeric user, a time and their date; others are dropped."""
    created = parse_timestamp(F.col("created_at")) if dict(events.dtypes)["created_at"] == "string" else F.col("created_at")
    out = events.withColumns({"created_at": created, "user_id": to_number(F.col("user_id")).cast("long")})
    return out.na.drop(subset=["user_id", "created_at"]).withColumn("event_date", F.to_date("created_at"))


def snapshot_calendar(orders: DataFrame, window: int = WINDOW_DAYS, gap: int = GAP_DAYS, keep: int = 12) -> DataFrame:
    """The last month starts that have a full window before and a full gap after them."""
    span = orders.agg(
        F.date_add(F.to_date(F.min("created_at")), window).alias("_from"), F.date_sub(F.to_date(F.max("created_at")), gap).alias("_to")
    )
    first = F.when(F.dayofmonth("_from") == 1, F.col("_from")).otherwise(F.add_months(F.trunc("_from", "month"), 1))
    months = span.select(first.alias("_first"), "_to").where(F.col("_first") <= F.col("_to"))
    spread = months.select(F.explode(F.sequence("_first", "_to", F.expr("INTERVAL 1 MONTH"))).alias("snapshot_date"))
    return spread.orderBy(F.desc("snapshot_date")).limit(keep)


def snapshot_dates(orders: DataFrame, window: int = WINDOW_DAYS, gap: int = GAP_DAYS, keep: int = 12) -> list[date]:
    """The calendar as at most ``keep`` literal dates, so that scans can be pruned by them."""
    return sorted(r["snapshot_date"] for r in snapshot_calendar(orders, window, gap, keep).collect())


def _in_history(window: int):
    """Whether a snapshot's window of days before it holds the row's day."""
    return lambda s: (s > F.col("_day")) & (s <= F.date_add("_day", window))


def _before(df: DataFrame, dates: Sequence[date], window: int) -> DataFrame:
    """Rows of the days that some snapshot window holds (a literal, pushable range)."""
    first, last = min(dates) - timedelta(days=window), max(dates)
    at = F.col("created_at")
    return df.where((at >= F.lit(str(first)).cast("timestamp")) & (at < F.lit(str(last)).cast("timestamp")))


def _to_history(df: DataFrame, dates: Sequence[date], window: int, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns, F.explode(F.filter(F.array(*[F.lit(d) for d in dates]), _in_history(window))).alias("snapshot_date"))


def _values_by_snapshot(df: DataFrame, dates: Sequence[date], holds, fields: Sequence[str], newest: str) -> DataFrame:
    """(snapshot, user, field, value): rows (``_n``) and largest ``newest`` (``_newest``) of every value.

    The rows are counted for all snapshots at once, by (user, field, value), and copied to the snapshots afterwards: what is
    shuffled does not grow with the number of windows that hold a day, and is combined map-side before.
    """
    texts = [F.col(c).cast("string").alias(f"_text_{c}") for c in fields]
    kept = list(dict.fromkeys(["user_id", "_day", newest]))
    pairs = [F.struct(F.lit(c).alias("_field"), F.col(f"_text_{c}").alias("_value")) for c in fields]
    long = df.select(*kept, *texts).select(*kept, F.inline(F.array(*pairs))).where(F.col("_value").isNotNull())
    held = [holds(F.lit(d)) for d in dates]
    counted = long.groupBy("user_id", "_field", "_value").agg(
        *[F.count_if(h).alias(f"_n{i}") for i, h in enumerate(held)],
        *[F.max(F.when(h, F.col(newest))).alias(f"_m{i}") for i, h in enumerate(held)],
    )
    each = [F.struct(F.lit(d).alias("snapshot_date"), F.col(f"_n{i}").alias("_n"), F.col(f"_m{i}").alias("_newest")) for i, d in enumerate(dates)]
    return counted.select("user_id", "_field", "_value", F.inline(F.filter(F.array(*each), lambda x: x["_n"] > 0)))


def _additive(lines: DataFrame, dates: Sequence[date], window: int) -> DataFrame:
    """Sums, means and recent sums: by (user, day) first, then by snapshot."""
    means = {
        "avg_order_value": "line_revenue",
        "avg_items_per_order_line": "num_of_item",
        "avg_margin_ratio": "margin_ratio",
        "return_rate": "is_returned",
        "cancel_rate": "is_cancelled",
        "shipped_rate": "is_shipped",
        "delivered_rate": "is_delivered",
        "avg_shipping_delay_days": "shipping_delay_days",
        "avg_delivery_days": "delivery_days",
        "avg_return_days": "return_days",
        "user_avg_review_len": "review_word_count",
        "user_negative_review_rate": "review_negative_flag",
        "user_positive_review_rate": "review_positive_flag",
        "user_avg_sentiment_score": "review_sentiment_score",
    }
    by_day = lines.groupBy("user_id", "_day").agg(
        F.count(F.lit(1)).alias("_lines"),
        F.min("created_at").alias("_first"),
        F.max("created_at").alias("_last"),
        total(F.col("num_of_item")).alias("_items"),
        total(F.col("line_revenue")).alias("_revenue"),
        total(F.col("line_profit")).alias("_profit"),
        F.sum("is_returned").alias("_returned"),
        F.count("review_text").alias("_reviews"),
        F.max("is_loyal").alias("_loyal"),
        *[F.sum(c).cast("double").alias(f"_s_{name}") for name, c in means.items()],
        *[F.count(c).alias(f"_c_{name}") for name, c in means.items()],
    )
    spread = _to_history(by_day, dates, window, by_day.columns)

    def recent(days: int, col: Column) -> Column:
        return F.when(F.col("_day") >= F.date_sub("snapshot_date", days), col)

    return spread.groupBy(*KEYS).agg(
        F.min("_first").alias("first_order_in_window"),
        F.max("_last").alias("last_order_in_window"),
        F.sum("_items").alias("items_cnt"),
        F.sum("_revenue").alias("total_revenue"),
        F.sum("_profit").alias("total_profit"),
        *[F.try_divide(F.sum(f"_s_{name}"), F.sum(f"_c_{name}")).alias(name) for name in means],
        F.max("_loyal").alias("is_loyal"),
        F.sum("_reviews").alias("user_review_count"),
        *[F.sum(recent(d, F.col("_revenue"))).alias(f"revenue_{d}d") for d in (30, 90)],
        *[F.try_divide(F.sum(recent(d, F.col("_returned"))), F.sum(recent(d, F.col("_lines")))).alias(f"return_rate_{d}d") for d in (30, 90)],
    )


def _profile(lines: DataFrame, dates: Sequence[date], window: int) -> DataFrame:
    """Distinct counts, favourites, median age and recent order counts."""
    fields = ["order_id", "category", "product_id", "brand", "traffic_source", "gender", "state", "age"]
    values = _values_by_snapshot(lines, dates, _in_history(window), fields, "_day")
    is_order = F.col("_field") == "order_id"
    age = F.when(F.col("_field") == "age", F.col("_value").try_cast("double"))
    out = values.groupBy(*KEYS).agg(
        distinct_in("order_id").alias("orders_cnt"),
        distinct_in("category").alias("unique_categories"),
        distinct_in("product_id").alias("unique_products"),
        distinct_in("brand").alias("unique_brands"),
        *[mode_in(c).alias(n) for n, c in [("favorite_category", "category"), ("favorite_brand", "brand"), ("traffic_source", "traffic_source"), ("gender", "gender"), ("state", "state")]],
        F.percentile(age, F.lit(0.5), F.col("_n")).alias("age"),
        *[F.count_if(is_order & (F.col("_newest") >= F.date_sub("snapshot_date", d))).alias(f"_orders_{d}d") for d in (30, 90)],
    )
    return out.na.fill("Unknown", ["favorite_category", "favorite_brand", "traffic_source", "gender", "state"])


def _events(events: DataFrame, dates: Sequence[date], window: int, event_types: Sequence[str]) -> DataFrame:
    fields = ["event_date", "session_id", "event_type"]
    values = _values_by_snapshot(events.withColumn("_day", F.col("event_date")), dates, _in_history(window), fields, "created_at")
    by_type = F.col("_field") == "event_type"
    out = values.groupBy(*KEYS).agg(
        F.sum(F.when(F.col("_field") == "event_date", F.col("_n"))).alias("events_cnt"),
        distinct_in("session_id").alias("sessions_cnt"),
        distinct_in("event_date").alias("active_days"),
        F.max("_newest").alias("last_event_at"),
        F.coalesce(mode_in("event_type"), F.lit("Unknown")).alias("favorite_event_type"),
        *[F.coalesce(F.sum(F.when(by_type & (F.col("_value") == t), F.col("_n"))), F.lit(0)).alias(f"event_{t.lower()}_cnt") for t in event_types],
    )
    return out.withColumn("days_since_last_event", whole_days(F.col("snapshot_date").cast("timestamp"), F.col("last_event_at")))


def _future_orders(orders: DataFrame, dates: Sequence[date], gap: int) -> DataFrame:
    first, end = min(dates), max(dates) + timedelta(days=gap)
    at, day = F.col("created_at"), F.col("_day")
    held = lambda s: (s <= day) & (s > F.date_sub(day, gap))
    ahead = orders.where((at >= F.lit(str(first)).cast("timestamp")) & (at < F.lit(str(end)).cast("timestamp")))
    orders_ahead = _values_by_snapshot(ahead.withColumn("_day", F.to_date("created_at")), dates, held, ["order_id"], "_day")
    return orders_ahead.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("future_orders_cnt"))


def snapshot_panel(
    orders: DataFrame,
    events: DataFrame,
    dates: Sequence[date],
    event_types: Sequence[str],
    window: int = WINDOW_DAYS,
    gap: int = GAP_DAYS,
    min_orders: int = 2,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> DataFrame:
    """One row for each snapshot and user with lines in the window.

    ``orders`` and ``events`` are prepared frames. The window ends before the snapshot
    instant: a line at midnight of the snapshot belongs to the future. Recent and event
    columns are NULL, not 0, where the user has no recent line or no event.
    """
    lines = review_features(_before(orders, dates, window), positive=positive, negative=negative)
    lines = lines.withColumn("_day", F.to_date("created_at"))
    panel = _additive(lines, dates, window)
    panel = panel.join(_profile(lines, dates, window), KEYS, "left")
    panel = panel.where(F.col("orders_cnt") >= min_orders)
    panel = panel.join(_events(_before(events, dates, window), dates, window, event_types), KEYS, "left")
    panel = panel.join(_future_orders(orders, dates, gap), KEYS, "left")
    snapshot = F.col("snapshot_date").cast("timestamp")
    first, last = F.col("first_order_in_window"), F.col("last_order_in_window")
    return panel.withColumns(
        {
            "recency_days": whole_days(snapshot, last),
            "tenure_days_in_window": clip(whole_days(last, first), 0),
            "purchase_frequency_30d": F.col("orders_cnt") / F.lit(max(window / 30, 1)),
            **{f"orders_cnt_{d}d": F.when(F.col(f"revenue_{d}d").isNotNull(), F.col(f"_orders_{d}d")) for d in (30, 90)},
            "future_orders_cnt": F.coalesce("future_orders_cnt", F.lit(0)),
            "churn_target": (F.coalesce("future_orders_cnt", F.lit(0)) == 0).cast("int"),
        }
    ).drop("_orders_30d", "_orders_90d")


NOT_FEATURES = {
    "user_id", "first_order_in_window", "last_order_in_window", "last_event_at", "future_orders_cnt", "snapshot_date", "churn_target",
    "is_train",
}


def time_split(panel: DataFrame, dates: Sequence[date], validation: int = 3) -> DataFrame:
    """Add ``is_train``: every snapshot but the last ``validation`` ones."""
    return panel.withColumn("is_train", F.col("snapshot_date") < F.lit(sorted(dates)[-validation]))


def feature_columns(panel: DataFrame) -> tuple[list[str], list[str]]:
    """(categorical, numeric) model inputs."""
    text = [n for n, t in panel.dtypes if t == "string" and n not in NOT_FEATURES]
    numeric = [n for n, t in panel.dtypes if t != "string" and n not in NOT_FEATURES]
    return text, numeric


def fill_features(panel: DataFrame) -> DataFrame:
    """Fill text gaps with ``Unknown`` and numeric gaps with the exact train median (0 if none)."""
    text, numeric = feature_columns(panel)
    base = stage(panel.withColumns({c: F.col(c).cast("double") for c in numeric}), "panel")
    middle = medians(base.where("is_train"), numeric, "").first()
    return base.na.fill("Unknown", text).na.fill({c: float(middle[c]) if middle[c] is not None else 0.0 for c in numeric})


def dataset_report(panel: DataFrame) -> DataFrame:
    """Rows and positive rate of the whole panel, the train and the validation part."""
    return panel.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("is_train").alias("train_rows"),
        F.count_if(~F.col("is_train")).alias("valid_rows"),
        F.avg(F.when(F.col("is_train"), F.col("churn_target"))).alias("positive_rate_train"),
        F.avg(F.when(~F.col("is_train"), F.col("churn_target"))).alias("positive_rate_valid"),
        F.max("snapshot_date").alias("latest_snapshot"),
    )
