"""Table profiles: missing values, numeric summaries, parse audits, distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions.ordering import quantiles
from basketry.functions.scalars import attach_row, parse_timestamp


def missing_report(df: DataFrame) -> DataFrame:
    """Missing count and percentage of every column, worst first (one pass)."""
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_cnt")) for c in df.columns]
    long = counts.select("_rows", F.inline(F.array(*pairs)))
    share = F.coalesce(F.try_divide(F.col("missing_cnt") * 100.0, F.col("_rows")), F.lit(0.0))
    return long.select("column", "missing_cnt", share.alias("missing_pct")).orderBy(F.desc("missing_pct"), "column")


def table_overview(df: DataFrame, name: str, top: int = 20) -> DataFrame:
    """Size, fully duplicated rows, and type and missing share of the worst columns."""
    types = [F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype")) for f in df.schema.fields]
    dtypes = df.sparkSession.range(1).select(F.inline(F.array(*types)))
    sizes = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n")).agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows")
    )
    worst = missing_report(df).limit(top).join(dtypes, "column")
    return attach_row(worst, sizes).select(
        F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("columns"), "duplicate_rows", "column", "dtype",
        F.round("missing_pct", 2).alias("missing_pct"),
    )


def describe_numbers(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, p1, p5, p50, p95, p99, max of the numeric columns."""
    columns = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])
    cuts = [0.01, 0.05, 0.5, 0.95, 0.99]
    labels = ["p1", "p5", "p50", "p95", "p99"]
    moments = df.agg(
        *[
            F.struct(
                F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
            ).alias(f"_m_{c}")
            for c in columns
        ]
    )
    found = quantiles(df, columns, cuts)
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"_m_{c}")[part].alias(part) for part in ["count", "mean", "std", "min", "max"]],
            *[F.col(c)[i].alias(label) for i, label in enumerate(labels)],
        )
        for c in columns
    ]
    return attach_row(moments, found).select(F.inline(F.array(*rows)))


def parse_audit(df: DataFrame, columns: Sequence[str], samples: int = 20) -> DataFrame:
    """How many texts of each time column fail to parse, with up to ``samples`` distinct ones."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "raw")
    parsed = long.withColumn("parsed", parse_timestamp(F.col("raw")))
    failed = F.col("raw").isNotNull() & F.col("parsed").isNull()
    counts = parsed.groupBy("column").agg(
        F.count("raw").alias("raw_non_null"), F.count("parsed").alias("parsed_non_null"), F.count_if(failed).alias("failed")
    )
    # the smallest texts by column: row_number below a limit is cut map-side before the shuffle
    ranked = parsed.where(failed).groupBy("column", "raw").agg(F.count(F.lit(1)).alias("_n"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("raw"))
    texts = ranked.withColumn("_place", place).where(F.col("_place") <= samples)
    texts = texts.groupBy("column").agg(F.sort_array(F.collect_list("raw")).alias("samples"))
    return counts.join(texts, "column", "left")


def box_statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Quartiles, the extremes inside 1.5 interquartile ranges and the count outside."""
    columns = list(columns)
    found = quantiles(df, columns, [0.25, 0.5, 0.75])
    joined = attach_row(df.select(*[F.col(c).cast("double").alias(c) for c in columns]), found.select(*[F.col(c).alias(f"_q_{c}") for c in columns]))
    parts = []
    for c in columns:
        q1, q3 = F.col(f"_q_{c}")[0], F.col(f"_q_{c}")[2]
        low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        inside = (F.col(c) >= low) & (F.col(c) <= high)
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.first(q1).alias("q1"),
                F.first(F.col(f"_q_{c}")[1]).alias("median"),
                F.first(q3).alias("q3"),
                F.min(F.when(inside, F.col(c))).alias("whisker_low"),
                F.max(F.when(inside, F.col(c))).alias("whisker_high"),
                F.count_if(~inside).alias("outliers"),
            )
        )
    return joined.agg(F.array(*parts).alias("_rows")).select(F.inline("_rows"))


def histogram(df: DataFrame, column: str, bins: int = 40) -> DataFrame:
    """Equal-width bins over the range of a column; empty bins count 0."""
    value = F.col(column).cast("double")
    present = df.where(F.col(column).isNotNull()).select(value.alias("v"))
    span = present.agg(F.min("v").alias("_low"), F.max("v").alias("_high"))
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.when(F.col("_high") == F.col("_low"), F.lit(0)).otherwise(F.floor((F.col("v") - F.col("_low")) / width))
    counted = attach_row(present, span).groupBy(F.least(place, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    all_bins = span.select("_low", width.alias("_width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return all_bins.join(counted, "bin", "left").select(
        "bin",
        (F.col("_low") + F.col("bin") * F.col("_width")).alias("low"),
        (F.col("_low") + (F.col("bin") + 1) * F.col("_width")).alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def fixed_sample(df: DataFrame, key: str, size: int = 5000, seed: int = 42) -> DataFrame:
    """A repeatable sample of at most ``size`` rows: the smallest MD5s of the key and the seed (top-k)."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(size)
