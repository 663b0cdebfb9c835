"""Derived columns of order lines: status flags, durations, money, calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions.scalars import days_between, non_negative


def status_flags(lines: DataFrame) -> DataFrame:
    """Exact-status flags; returned means a return time is present."""
    status = F.coalesce(F.col("status"), F.lit(""))
    return lines.withColumns(
        {
            "is_returned": F.col("returned_at").isNotNull().cast("int"),
            "is_cancelled": (status == "Cancelled").cast("int"),
            "is_completed": (status == "Complete").cast("int"),
            "is_shipped": (status == "Shipped").cast("int"),
        }
    )


def loose_status_flags(lines: DataFrame) -> DataFrame:
    """Flags by time stamps; cancelled is any status holding "cancel" in any case."""
    cancelled = F.contains(F.lower(F.col("status")), F.lit("cancel"))
    return lines.withColumns(
        {
            "is_returned": F.col("returned_at").isNotNull().cast("int"),
            "is_shipped": F.col("shipped_at").isNotNull().cast("int"),
            "is_delivered": F.col("delivered_at").isNotNull().cast("int"),
            "is_cancelled": F.coalesce(cancelled, F.lit(False)).cast("int"),
        }
    )


def _durations() -> dict[str, Column]:
    created, shipped = F.col("created_at"), F.col("shipped_at")
    return {
        "shipping_delay_days": days_between(shipped, created),
        "delivery_days": days_between(F.col("delivered_at"), created),
        "return_days": days_between(F.col("returned_at"), created),
        "delivery_gap_days": days_between(F.col("delivered_at"), shipped),
    }


def durations(lines: DataFrame) -> DataFrame:
    """Fractional-day durations as they are, negatives included."""
    return lines.withColumns(_durations())


def valid_durations(lines: DataFrame) -> DataFrame:
    """Fractional-day durations; negative ones become NULL."""
    return lines.withColumns({name: non_negative(col) for name, col in _durations().items()})


def unit_margin(lines: DataFrame) -> DataFrame:
    """Margin of one unit."""
    return lines.withColumn("margin", F.col("sale_price") - F.col("cost"))


def line_money(lines: DataFrame) -> DataFrame:
    """Revenue, cost and profit of the line."""
    n = F.col("num_of_item")
    return lines.withColumns(
        {
            "line_revenue": F.col("sale_price") * n,
            "line_cost": F.col("cost") * n,
            "line_profit": F.col("sale_price") * n - F.col("cost") * n,
        }
    )


def money_ratios(lines: DataFrame) -> DataFrame:
    """``discount_ratio`` (0 without a retail price) and ``margin_ratio`` (NULL without revenue)."""
    retail = F.col("retail_price")
    return lines.withColumns(
        {
            "discount_ratio": F.when(retail > 0, 1 - F.col("sale_price") / retail).otherwise(F.lit(0.0)),
            "margin_ratio": F.when(F.col("line_revenue") > 0, F.col("line_profit") / F.col("line_revenue")),
        }
    )


def unit_margin_ratio(lines: DataFrame) -> DataFrame:
    """Margin over price for one unit, 0 where the price is 0."""
    price = F.col("sale_price")
    return lines.withColumn("margin_ratio", F.when(price == 0, F.lit(0.0)).otherwise(F.try_divide(price - F.col("cost"), price)))


def calendar(lines: DataFrame, at: str = "created_at") -> DataFrame:
    """Date, month text, ISO week, weekday name and hour of a time column."""
    t = F.col(at)
    return lines.withColumns(
        {
            "order_date": F.to_date(t),
            "order_month": F.date_format(t, "yyyy-MM"),
            "order_week": F.weekofyear(t).cast("long"),
            "day_of_week": F.date_format(t, "EEEE"),
            "hour": F.hour(t),
        }
    )


def enrich_orders(lines: DataFrame) -> DataFrame:
    """Order lines as the customer, product and retention operators expect them."""
    out = unit_margin(status_flags(lines))
    return out.withColumns(
        {
            "shipping_days": days_between(F.col("shipped_at"), F.col("created_at")),
            "delivery_days": days_between(F.col("delivered_at"), F.col("created_at")),
        }
    )


def enrich_sales(lines: DataFrame) -> DataFrame:
    """Order lines as the sales, geography and quality marts expect them."""
    return money_ratios(line_money(valid_durations(loose_status_flags(calendar(lines)))))
