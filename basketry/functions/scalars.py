"""Column expressions with the missing-value rules of the retail data model.

Missing is always NULL (never NaN), a bad parse is NULL, a division by zero is 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Mojibake sequences and their repairs, applied in this order.
MOJIBAKE = [
    ("Â®", "®"),
    ("Â©", "©"),
    ("â€™", "'"),
    ("â€“", "-"),
    ("â€”", "-"),
]

# Text tokens that mean "missing".
MISSING_TOKENS = ["nan", "None", ""]

MICROS_PER_DAY = 86_400_000_000


def parse_timestamp(col: Column, formats: Sequence[str] = ()) -> Column:
    """UTC timestamp from mixed text forms; NULL where nothing parses."""
    text = F.trim(col.cast("string"))
    return F.coalesce(text.try_cast("timestamp"), *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def to_number(col: Column, default: Column | float | None = None) -> Column:
    """Double from any column; unparseable text and NaN become ``default`` (or NULL)."""
    number = col.try_cast("double")
    number = F.when(~F.isnan(number), number)
    if default is None:
        return number
    return F.coalesce(number, default if isinstance(default, Column) else F.lit(float(default)))


def repair_text(col: Column) -> Column:
    """Undo the known UTF-8-read-as-Latin sequences."""
    for broken, fixed in MOJIBAKE:
        col = F.replace(col, F.lit(broken), F.lit(fixed))
    return col


def blank_to_null(col: Column) -> Column:
    """Trimmed text; the missing tokens become NULL."""
    text = F.trim(col)
    return F.when(~text.isin(MISSING_TOKENS), text)


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, 0 where undefined."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def clip(col: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Bound a value; NULL stays NULL (greatest/least alone would skip it)."""
    out = col
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(col.isNotNull(), out)


def days_between(later: Column, earlier: Column) -> Column:
    """Elapsed time in fractional days."""
    return (F.unix_micros(later) - F.unix_micros(earlier)).cast("double") / F.lit(float(MICROS_PER_DAY))


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed whole days, floored (not a calendar-day difference)."""
    return F.floor(days_between(later, earlier)).cast("long")


def non_negative(col: Column) -> Column:
    """NULL where the value is negative."""
    return F.when(col >= 0, col)


def total(col: Column) -> Column:
    """Sum where an all-missing group gives 0."""
    return F.coalesce(F.sum(col), F.lit(0.0))


def most_common(col: Column, default: str) -> Column:
    """Most frequent non-missing value, the smallest among ties."""
    return F.coalesce(F.mode(col, deterministic=True), F.lit(default))


def sample_std(col: Column) -> Column:
    """Sample standard deviation; 0 for a single row."""
    return F.coalesce(F.stddev_samp(col), F.lit(0.0))


def known_value(
    df: DataFrame, feature: str, known_at: str | None = None, as_of: str = "created_at", fill: Column | None = None
) -> DataFrame:
    """Point-in-time mask: add ``<feature>_is_known`` (byte) and ``<feature>_value``.

    A value counts as known when it is present and, if ``known_at`` is given and exists,
    was recorded no later than ``as_of``.
    """
    value = F.col(feature)
    known = value.isNotNull()
    if known_at is not None and known_at in df.columns:
        known = known & F.coalesce(F.col(known_at) <= F.col(as_of), F.lit(False))
    return df.withColumn(f"{feature}_is_known", known.cast("byte")).withColumn(
        f"{feature}_value", F.when(known, value).otherwise(fill if fill is not None else F.lit(None))
    )


def risk_band(score: Column) -> Column:
    """low up to .35, medium up to .65, high up to 1.01 (each bound inclusive above)."""
    return (
        F.when((score > -0.01) & (score <= 0.35), "low")
        .when((score > 0.35) & (score <= 0.65), "medium")
        .when((score > 0.65) & (score <= 1.01), "high")
    )


# Right-closed age bins and their labels.
AGE_BINS = [(14, 24, "14-24"), (24, 34, "25-34"), (34, 44, "35-44"), (44, 54, "45-54"), (54, 64, "55-64"), (64, 100, "65+")]


def age_group(age: Column) -> Column:
    """Age band; exactly 14, under 14 and over 100 get none."""
    band = F.lit(None).cast("string")
    for low, high, label in reversed(AGE_BINS):
        band = F.when((age > low) & (age <= high), F.lit(label)).otherwise(band)
    return band


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def empty_list(of: str) -> Column:
    """A list without values, for rows of another kind: batches to Python take time by the square of their null lists."""
    return F.array().cast(f"array<{of}>")


def attach_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame (table-level statistics) to every row.

    A scalar subquery: it runs once and its result is a constant of the outer plan.
    """
    packed = one_row.select(F.struct(*one_row.columns)).scalar()
    return df.withColumn("_row", packed).select(*df.columns, *[F.col("_row")[c].alias(c) for c in one_row.columns])
