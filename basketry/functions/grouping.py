"""Distinct counts and most common values of many columns in one two-level aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """(keys, _field, _value, _n): how often every non-missing value of every column occurs.

    The counts are combined map-side and shuffled by (keys, field, value), so a key that
    holds a third of the rows is spread by its values.
    """
    texts = [F.col(c).cast("string").alias(c) for c in columns]
    carried = [weight] if weight else []
    long = df.select(*keys, *carried, *texts).unpivot([*keys, *carried], list(columns), "_field", "_value")
    size = F.sum(weight) if weight else F.count(F.lit(1))
    return long.where(F.col("_value").isNotNull()).groupBy(*keys, "_field", "_value").agg(size.alias("_n"))


def distinct_in(field: str):
    """Distinct values of one column, over ``value_counts_long`` rows."""
    return F.count_if(F.col("_field") == field)


def mode_in(field: str):
    """Most common value of one column (smallest among ties), over ``value_counts_long`` rows."""
    return F.min(F.when(F.col("_field") == field, F.struct((-F.col("_n")).alias("n"), F.col("_value").alias("v"))))["v"]


def median_in(field: str):
    """Median of one column of numbers, over ``value_counts_long`` rows."""
    return F.percentile(F.when(F.col("_field") == field, F.col("_value").cast("double")), F.lit(0.5), F.col("_n"))


def with_value_profile(
    grouped: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    distinct: Mapping[str, str] | None = None,
    modes: Mapping[str, str] | None = None,
    default: str = "Unknown",
    middles: Mapping[str, str] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Join distinct counts (``{output: column}``), modes and medians of numbers onto an aggregate by ``keys``.

    With ``weight``, a row of ``rows`` stands for that many.
    """
    distinct, modes, middles = dict(distinct or {}), dict(modes or {}), dict(middles or {})
    columns = list(dict.fromkeys([*distinct.values(), *modes.values(), *middles.values()]))
    profile = value_counts_long(rows, keys, columns, weight).groupBy(*keys).agg(
        *[distinct_in(c).alias(name) for name, c in distinct.items()],
        *[mode_in(c).alias(name) for name, c in modes.items()],
        *[median_in(c).alias(name) for name, c in middles.items()],
    )
    return grouped.join(profile, list(keys), "left").select(
        *grouped.columns,
        *[F.coalesce(name, F.lit(0)).alias(name) for name in distinct],
        *[F.coalesce(name, F.lit(default)).alias(name) for name in modes],
        *middles,
    )
