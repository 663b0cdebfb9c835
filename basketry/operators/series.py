"""Time-series tables: lags, rolling windows, folds, outlook and error measures.

Every function takes optional series keys. A window then runs inside a series; its rows are
periods (days, weeks, months), not order lines, so a window never sees raw data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from basketry.functions.scalars import attach_row, total


def _along(date: str, keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(date)


def monthly_revenue(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Revenue of every month with sales."""
    dated = lines.where(F.col("created_at").isNotNull())
    return dated.groupBy(*keys, F.trunc("created_at", "month").alias("month")).agg(total(F.col("sale_price")).alias("revenue"))


def sales_outlook(monthly: DataFrame, keys: Sequence[str] = (), steps: int = 3) -> DataFrame:
    """Next months: mean of the last three plus the mean recent step, never below zero.

    The step is the mean of the last three month-on-month differences within the last six
    months (0 if there is only one month).
    """
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("month")))
    recent = monthly.withColumn("_place", newest).where(F.col("_place") <= 6)
    change = F.col("revenue") - F.lag("revenue").over(_along("month", keys))
    recent = recent.withColumn("_change", change)
    last_three = F.col("_place") <= 3
    summary = recent.groupBy(*keys).agg(
        F.max("month").alias("_last"),
        F.avg(F.when(last_three, F.col("revenue"))).alias("_base"),
        F.coalesce(F.avg(F.when(last_three, F.col("_change"))), F.lit(0.0)).alias("_trend"),
    )
    ahead = summary.where(F.col("_last").isNotNull()).select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_step"))
    return ahead.select(
        *keys,
        F.date_format(F.add_months("_last", F.col("_step")), "yyyy-MM").alias("month"),
        F.greatest(F.col("_base") + F.col("_trend") * F.col("_step"), F.lit(0.0)).alias("forecast_revenue"),
        F.lit("last_3_month_average_plus_short_trend").alias("method"),
    )


def calendar_features(daily: DataFrame, date: str = "order_date", keys: Sequence[str] = ()) -> DataFrame:
    """Weekday (Monday 0), month, ISO week, weekend flag, day, position and log revenue."""
    d = F.col(date)
    return daily.withColumns(
        {
            "day_of_week_num": F.weekday(d),
            "month_num": F.month(d),
            "week_num": F.weekofyear(d),
            "is_weekend": F.weekday(d).isin(5, 6).cast("int"),
            "day_of_month": F.dayofmonth(d),
            "time_idx": F.row_number().over(_along(date, keys)) - 1,
            "revenue_log": F.log1p(F.col("revenue")),
        }
    )


def period_features(periods: DataFrame, date: str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """Month, quarter and position of a monthly or weekly series."""
    return periods.withColumns(
        {"month": F.month(date), "quarter": F.quarter(date), "time_idx": F.row_number().over(_along(date, keys)) - 1}
    )


def add_lags(
    df: DataFrame,
    targets: Sequence[str],
    lags: Sequence[int],
    windows: Sequence[int],
    date: str,
    keys: Sequence[str] = (),
    with_std: bool = False,
    names: tuple[str, str, str] = ("{t}_lag_{n}", "{t}_roll_mean_{n}", "{t}_roll_std_{n}"),
) -> DataFrame:
    """Lagged values and rolling statistics of the preceding rows; NULL until the window is full."""
    order = _along(date, keys)
    columns: dict[str, Column] = {}
    for t in targets:
        for n in lags:
            columns[names[0].format(t=t, n=n)] = F.lag(t, n).over(order)
        for n in windows:
            frame = order.rowsBetween(-n, -1)
            full = F.count(t).over(frame) == n
            columns[names[1].format(t=t, n=n)] = F.when(full, F.avg(t).over(frame))
            if with_std:
                columns[names[2].format(t=t, n=n)] = F.when(full, F.stddev_samp(t).over(frame))
    return df.withColumns(columns)


def daily_model_table(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Daily features with lags 1/7/14/28 and rolling 7/14/28 of the three targets; full rows only."""
    base = calendar_features(daily, keys=keys)
    out = add_lags(base, ["revenue", "orders_cnt", "revenue_log"], [1, 7, 14, 28], [7, 14, 28], "order_date", keys, with_std=True)
    return out.na.drop()


PLAIN_NAMES = ("lag_{n}", "rolling_mean_{n}", "rolling_std_{n}")
MONTHLY_FEATURES = ["lag_1", "lag_2", "lag_3", "lag_6", "rolling_mean_3", "rolling_mean_6", "month", "quarter", "time_idx"]
REDUCED_FEATURES = ["lag_1", "lag_6", "rolling_mean_6", "month", "time_idx"]
WEEKLY_FEATURES = ["lag_1", "lag_4", "lag_12", "rolling_mean_4", "rolling_mean_12", "month", "quarter", "time_idx"]


def _period_model_table(periods: DataFrame, lags, windows, measure, keys) -> DataFrame:
    target = F.col(measure).cast("double").alias("target")
    base = period_features(periods.select(*keys, "date", target), "date", keys)
    return add_lags(base, ["target"], lags, windows, "date", keys, names=PLAIN_NAMES).na.drop()


def monthly_model_table(monthly: DataFrame, measure: str = "items", keys: Sequence[str] = ()) -> DataFrame:
    """Monthly target with lags 1/2/3/6 and rolling means 3/6; the index counts from the first month."""
    return _period_model_table(monthly, [1, 2, 3, 6], [3, 6], measure, keys)


def weekly_model_table(weekly: DataFrame, measure: str = "items", keys: Sequence[str] = ()) -> DataFrame:
    """Weekly target with lags 1/4/12 and rolling means 4/12; the index counts from the first week."""
    return _period_model_table(weekly, [1, 4, 12], [4, 12], measure, keys)


def date_split(df: DataFrame, date: str = "order_date", share: float = 0.85) -> DataFrame:
    """Add ``is_train``: dates up to the interpolated quantile of all dates (few distinct values)."""
    day = F.unix_date(date).cast("double")
    return attach_row(df, df.agg(F.percentile(day, F.lit(share)).alias("_cut"))).withColumn("is_train", day <= F.col("_cut")).drop("_cut")


def expanding_folds(df: DataFrame, date: str = "date", keys: Sequence[str] = (), folds: int = 5) -> DataFrame:
    """Add ``row_idx`` and ``fold`` (1..folds where the row is tested, 0 before the first test).

    Fold i is tested on rows of fold i and trained on every row before them.
    """
    counted = df.withColumn("row_idx", F.row_number().over(_along(date, keys)) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))
    )
    size = F.floor(F.col("_n") / (folds + 1))
    start = F.col("_n") - folds * size
    fold = F.when(F.col("row_idx") >= start, F.floor((F.col("row_idx") - start) / size) + 1).otherwise(0)
    return counted.withColumn("fold", fold.cast("int")).drop("_n")


def naive_fold_error(folded: DataFrame) -> DataFrame:
    """Mean absolute error by fold of predicting the previous period."""
    error = F.abs(F.col("target") - F.col("lag_1"))
    return folded.where(F.col("fold") > 0).groupBy("fold").agg(F.avg(error).alias("mae"))


def error_measures(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and WAPE."""
    gap = F.col(actual) - F.col(predicted)
    return df.groupBy(*by).agg(
        F.avg(F.abs(gap)).alias("mae"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.try_divide(F.sum(F.abs(gap)), F.sum(F.abs(F.col(actual)))).alias("wape"),
    )


def with_abs_error(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("abs_error", F.abs(F.col(actual) - F.col(predicted)))
