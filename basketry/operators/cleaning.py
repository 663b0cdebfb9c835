"""Cleaning of raw order lines and events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions.ordering import Score, add_scores, medians, quantiles, quintile_ends
from basketry.functions.scalars import (
    attach_row,
    blank_to_null,
    clip,
    parse_timestamp,
    repair_text,
    string_columns,
    to_number,
)
from basketry.session import stage

TIME_COLUMNS = ["created_at", "returned_at", "shipped_at", "delivered_at", "sold_at"]
PRICE_COLUMNS = ["sale_price", "cost", "retail_price", "product_retail_price"]
TEXT_COLUMNS = ["product_name", "customer_review", "category", "brand", "department"]
ORDER_FILL = ["city", "brand", "product_brand", "product_name", "product_name_clean", "customer_review", "traffic_source", "state"]
EVENT_FILL = ["city", "state", "browser", "traffic_source", "event_type", "uri"]


def present(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of ``columns`` that the frame has."""
    return [c for c in columns if c in df.columns]


def parse_times(df: DataFrame, columns: Sequence[str] = TIME_COLUMNS) -> DataFrame:
    return df.withColumns({c: parse_timestamp(F.col(c)) for c in present(df, columns)})


def parse_numbers(df: DataFrame, columns: Sequence[str], default: float | None = None) -> DataFrame:
    return df.withColumns({c: to_number(F.col(c), default) for c in present(df, columns)})


def repair_texts(df: DataFrame, columns: Sequence[str] = TEXT_COLUMNS) -> DataFrame:
    return df.withColumns({c: repair_text(F.col(c)) for c in present(df, columns)})


def blanks_to_null(df: DataFrame) -> DataFrame:
    """Trim every text column; the missing tokens become NULL."""
    texts = string_columns(df)
    return df.withColumns({c: blank_to_null(F.col(c)) for c in texts}) if texts else df


def fill_constant(df: DataFrame, columns: Sequence[str], value: str = "Unknown") -> DataFrame:
    return df.na.fill(value, present(df, columns))


def fill_from(df: DataFrame, column: str, other: str) -> DataFrame:
    """Fill the gaps of one column from another."""
    return df.withColumn(column, F.coalesce(F.col(column), F.col(other)))


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    """Fill the gaps with the most common value (smallest among ties).

    Values are counted first, so a wide column is never held in one task.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    top = counted.orderBy(F.desc("_n"), column).limit(1).agg(F.first(column).alias("_mode"))
    return attach_row(df, top).withColumn(column, F.coalesce(F.col(column), F.col("_mode"))).drop("_mode")


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fill the gaps of numeric columns with their exact medians."""
    columns = present(df, columns)
    filled = attach_row(df, medians(df, columns))
    return filled.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"{c}_median")) for c in columns}).drop(
        *[f"{c}_median" for c in columns]
    )


def null_outside(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).between(low, high), F.col(column)))


def null_negative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) >= 0, F.col(c)) for c in present(df, columns)})


def floor_counts(df: DataFrame, column: str = "num_of_item") -> DataFrame:
    """Counts of zero or less become 1; missing stays missing."""
    return df.withColumn(column, F.when(F.col(column) <= 0, F.lit(1)).otherwise(F.col(column)))


def winsorise(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip columns to their own exact quantiles; missing stays missing."""
    columns = present(df, columns)
    bounds = quantiles(df, columns, [low, high]).select(*[F.col(c).alias(f"_b_{c}") for c in columns])
    clipped = {c: clip(F.col(c).cast("double"), F.col(f"_b_{c}")[0], F.col(f"_b_{c}")[1]) for c in columns}
    return attach_row(df, bounds).withColumns(clipped).drop(*[f"_b_{c}" for c in columns])


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Rows before, fully duplicated rows and rows after removing them."""
    sizes = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    rows = F.coalesce(F.sum("_n"), F.lit(0))
    return sizes.agg(rows.alias("rows_before"), (rows - F.count(F.lit(1))).alias("duplicates"), F.count(F.lit(1)).alias("rows_after"))


def empty_columns(df: DataFrame) -> list[str]:
    """Columns without any value (one pass; only column names reach the driver)."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return [c for c in df.columns if counts[c] == 0]


def drop_empty_columns(df: DataFrame) -> DataFrame:
    return df.drop(*empty_columns(df))


def duplicate_columns(df: DataFrame) -> dict[str, str]:
    """{column: the earlier column it equals}, same type and NULL equal to NULL.

    One pass sums a hash of every column's value together with its row, which tells permuted columns apart; only
    columns whose sums agree are then compared value by value, with each column found different so far.
    """
    types = dict(df.dtypes)
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    sums = df.agg(*[F.sum(F.shiftright(F.xxhash64(F.col(f"`{c}`"), row), 32)).alias(f"s{i}") for i, c in enumerate(df.columns)]).first()
    groups: dict[tuple, list[str]] = {}
    for i, c in enumerate(df.columns):
        groups.setdefault((types[c], sums[i]), []).append(c)
    found: dict[str, str] = {}
    open_groups = [g for g in groups.values() if len(g) > 1]
    while open_groups:
        pairs = [(g[0], c) for g in open_groups for c in g[1:]]
        same = df.agg(*[F.bool_and(F.col(f"`{a}`").eqNullSafe(F.col(f"`{b}`"))).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
        equal = {b: a for i, (a, b) in enumerate(pairs) if same[i]}
        found |= equal
        open_groups = [rest for g in open_groups if len(rest := [c for c in g[1:] if c not in equal]) > 1]
    return {c: found[c] for c in df.columns if c in found}


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    return df.drop(*duplicate_columns(df))


def identifier_columns(df: DataFrame, screen_error: float = 0.05) -> list[str]:
    """Columns whose values (NULL counted as one value) are all different.

    A sketch pass screens the columns; the survivors are confirmed by looking for one
    repeated value.
    """
    rough = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.approx_count_distinct(F.col(c).cast("string"), screen_error).alias(c) for c in df.columns]
    ).first()
    rows = rough["_rows"]
    candidates = [c for c in df.columns if rough[c] >= rows * (1 - 5 * screen_error) - 1]
    return [c for c in candidates if df.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").isEmpty()] if rows else []


def drop_identifier_columns(df: DataFrame) -> DataFrame:
    return df.drop(*identifier_columns(df))


def drop_missing_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(keys))


def min_max(df: DataFrame, columns: Mapping[str, str] | Sequence[str]) -> DataFrame:
    """Scale columns to 0..1 over the table; missing counts as 0, a constant column gives 0.

    ``columns`` may map a source column to its output name.
    """
    names = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names}
    bounds = df.agg(*[F.min(v).alias(f"_lo_{c}") for c, v in filled.items()], *[F.max(v).alias(f"_hi_{c}") for c, v in filled.items()])
    scaled = {
        out: F.when(F.col(f"_hi_{c}") == F.col(f"_lo_{c}"), F.lit(0.0)).otherwise(
            (filled[c] - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}"))
        )
        for c, out in names.items()
    }
    return attach_row(df, bounds).withColumns(scaled).drop(*[f"_{side}_{c}" for side in ("lo", "hi") for c in names])


def add_quintile(df: DataFrame, column: str, name: str, key: str) -> DataFrame:
    """Equal-frequency quintile 1..5 of a column, ties by ``key``; ``df`` must be staged."""
    return add_scores(df, key, [Score(name, column, quintile_ends)])


def top_levels(df: DataFrame, column: str, size: int) -> list[str]:
    """The most frequent levels, missing as ``unknown`` (at most ``size`` names on the driver)."""
    value = F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("level")
    counted = df.select(value).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    return [r["level"] for r in counted.orderBy(F.desc("n"), "level").limit(size).collect()]


def one_hot_top(df: DataFrame, column: str, prefix: str, size: int = 25) -> DataFrame:
    """Add a float 0/1 column for each of the top levels and ``<prefix>_other`` for the rest.

    The ``other`` column exists only if some level lies beyond the top ones.
    """
    value = F.coalesce(F.col(column).cast("string"), F.lit("unknown"))
    levels = top_levels(df, column, size + 1)
    kept, more = levels[:size], len(levels) > size
    clipped = F.when(value.isin(kept), value).otherwise(F.lit("other"))
    names = sorted({*kept, "other"} if more else set(kept))
    return df.withColumns({f"{prefix}_{level}": (clipped == level).cast("float") for level in names})


def clean_orders(raw: DataFrame, winsor: bool = False) -> DataFrame:
    """Typed, de-duplicated order lines with gaps filled and impossible values removed.

    With ``winsor`` prices are first clipped to their 1% and 99% quantiles. Lines are parsed and compared once: the passes
    that follow read the different ones.
    """
    df = stage(blanks_to_null(parse_times(raw)).dropDuplicates(), "different-lines")
    if "sold_at" in df.columns and "sold_at" in empty_columns(df.select("sold_at")):
        df = df.drop("sold_at")
    df = fill_constant(df, ORDER_FILL)
    if {"product_name_clean", "product_name"} <= set(df.columns):
        df = fill_from(df, "product_name_clean", "product_name")
    df = parse_numbers(df, ["age", "num_of_item", *PRICE_COLUMNS])
    if "num_of_item" in df.columns:
        df = floor_counts(df)
    if "age" in df.columns:
        df = null_outside(df, "age", 14, 100)
    if winsor:
        df = winsorise(df, PRICE_COLUMNS)
    return fill_median(null_negative(df, PRICE_COLUMNS), ["age", *PRICE_COLUMNS])


def clean_events(raw: DataFrame) -> DataFrame:
    """Typed, de-duplicated events with text gaps filled; the user may stay missing."""
    df = blanks_to_null(parse_times(raw, ["created_at"])).dropDuplicates()
    df = fill_constant(df, EVENT_FILL)
    return df.withColumn("user_id", to_number(F.col("user_id")).cast("long"))
