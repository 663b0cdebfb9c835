"""Global ranks, running sums and quantiles without a one-task window.

Rows are cut into ordered buckets by literal cut points on the sort value. A bucket is a
pure function of the row, so the answer is exact however good the cuts are; the cuts only
balance the work. Every cut value gets a bucket of its own, and that bucket is split again
on the tie key, so one value shared by a third of the rows is still spread over many tasks.

Only bounded metadata (cut points, bucket totals, boundary rows) reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.session import stage

# Beyond this many distinct values the built-in exact percentile (a value -> count map
# merged in one task) gives way to the bucketed search.
PERCENTILE_MAP_LIMIT = 100_000


def bucket_count(df: DataFrame) -> int:
    """Cut points to ask for: about one bucket for each shuffle partition, within bounds."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(8, min(128, partitions))


def cut_points(df: DataFrame, columns: Sequence[str], buckets: int) -> list[list[float]]:
    """Approximate equi-depth cut points of each column, from one sketch pass."""
    probabilities = [i / buckets for i in range(1, buckets)]
    found = df.approxQuantile(list(columns), probabilities, 1.0 / (4 * buckets))
    return [sorted(set(cuts)) for cuts in found]


def count_below(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points smaller than ``value``.

    A balanced CASE tree over every sixteenth cut, then a count inside one sixteen-long
    chunk of a literal array: generated code stays small however many cuts there are.
    """
    cuts = [float(c) for c in cuts]

    def tree(points: Sequence[float], low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value > F.lit(points[middle]), tree(points, middle + 1, high)).otherwise(tree(points, low, middle))

    step = 16
    if len(cuts) <= step:
        return tree(cuts, 0, len(cuts))
    coarse = cuts[step - 1 :: step]
    chunk = tree(coarse, 0, len(coarse))
    empty = F.array().cast("array<double>")
    chunks = [F.array(*map(F.lit, cuts[i : i + step])) if i < len(cuts) else empty for i in range(0, step * (len(coarse) + 1), step)]
    inside = F.size(F.filter(F.element_at(F.array(*chunks), chunk + 1), lambda c: c < value))
    return chunk * step + inside


def order_bucket(value: Column, tie: Column, cuts: Sequence[float], tie_cuts: Sequence[float]) -> tuple[Column, Column]:
    """(bucket, part), which ascend with (value, tie)."""
    on_cut = value.isin([float(c) for c in cuts]) if cuts else F.lit(False)
    bucket = count_below(value, cuts) * 2 + on_cut.cast("int")
    part = F.when(on_cut, count_below(tie.cast("double"), tie_cuts)).otherwise(F.lit(0))
    return bucket, part


def running(
    df: DataFrame,
    value: str,
    tie: str,
    sums: Sequence[str] = (),
    descending: bool = False,
    staged: bool = False,
) -> DataFrame:
    """Global ``row_rank`` (1-based), ``row_total`` and, for every column in ``sums``,
    ``cum_<c>`` and ``total_<c>``, in the order (value, tie ascending).

    ``value`` must not be null. ``tie`` must be a numeric key that makes the order total.
    """
    base = df if staged else stage(df, "running")
    signed = F.col(value).cast("double")
    base = base.withColumn("_v", -signed if descending else signed)
    cuts, tie_cuts = cut_points(base, ["_v", tie], bucket_count(base))
    bucket, part = order_bucket(F.col("_v"), F.col(tie), cuts, tie_cuts)
    base = base.withColumn("_bucket", bucket).withColumn("_part", part)
    keys = ["_bucket", "_part"]
    totals = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"_s_{c}") for c in sums]
    )
    # one row for each bucket, so the unpartitioned windows below are over a bounded table
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.sum("_n").over(whole).alias("row_total"),
        *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0.0)).alias(f"_s0_{c}") for c in sums],
        *[F.sum(f"_s_{c}").over(whole).alias(f"total_{c}") for c in sums],
    )
    inside = Window.partitionBy(*keys).orderBy("_v", tie)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = base.join(F.broadcast(offsets), keys)
    out = out.withColumn("row_rank", F.col("_n0") + F.row_number().over(inside))
    for c in sums:
        out = out.withColumn(f"cum_{c}", F.col(f"_s0_{c}") + F.coalesce(F.sum(c).over(upto), F.lit(0.0)))
    return out.drop(*keys, "_v", "_n0", *[f"_s0_{c}" for c in sums])


def locate(
    long: DataFrame,
    cuts: Mapping[int, tuple[Sequence[float], Sequence[float]]],
    positions: Callable[[int, int], list[int]],
) -> dict[int, tuple[int, dict[int, tuple[float, float]]]]:
    """The (value, tie) pair at wanted global positions of several orders at once.

    ``long`` has (_spec, _v, _t, _w): an order number, the value and tie to sort by and how
    many rows the entry stands for; it must be (a projection of) a staged table.
    ``positions(spec, n)`` names the 1-based positions for an order of n rows. Two jobs:
    bucket totals, combined map-side; then only the buckets that hold a wanted position are
    sorted. Returns ``{spec: (n, {position: (value, tie)})}``.
    """
    bucket = part = F.lit(0)
    for spec, (value_cuts, tie_cuts) in cuts.items():
        b, t = order_bucket(F.col("_v"), F.col("_t"), value_cuts, tie_cuts)
        bucket = F.when(F.col("_spec") == spec, b).otherwise(bucket)
        part = F.when(F.col("_spec") == spec, t).otherwise(part)
    tagged = long.withColumn("_bucket", bucket).withColumn("_part", part)
    keys = ["_spec", "_bucket", "_part"]
    totals = sorted(tuple(r) for r in tagged.groupBy(*keys).agg(F.sum("_w")).collect())
    sizes: dict[int, int] = {}
    for spec, _, _, n in totals:
        sizes[spec] = sizes.get(spec, 0) + n
    wanted_at = {spec: [p for p in positions(spec, n) if 1 <= p <= n] for spec, n in sizes.items()}
    wanted: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    start = dict.fromkeys(sizes, 0)
    for spec, b, t, n in totals:
        here = [(p, p - start[spec]) for p in wanted_at[spec] if start[spec] < p <= start[spec] + n]
        if here:
            wanted[(spec, b, t)] = here
        start[spec] += n
    found: dict[int, tuple[int, dict[int, tuple[float, float]]]] = {spec: (n, {}) for spec, n in sizes.items()}
    if not wanted:
        return found
    hit = pick = F.lit(False)
    for (spec, b, t), pairs in wanted.items():
        here = (F.col("_spec") == spec) & (F.col("_bucket") == b) & (F.col("_part") == t)
        hit = hit | here
        for local in sorted({local for _, local in pairs}):
            pick = pick | (here & (F.col("_upto") >= local) & (F.col("_upto") - F.col("_w") < local))
    upto = Window.partitionBy(*keys).orderBy("_v", "_t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for row in tagged.where(hit).withColumn("_upto", F.sum("_w").over(upto)).where(pick).collect():
        for position, local in wanted[(row["_spec"], row["_bucket"], row["_part"])]:
            if row["_upto"] - row["_w"] < local <= row["_upto"]:
                found[row["_spec"]][1][position] = (row["_v"], row["_t"])
    return found


@dataclass(frozen=True)
class Score:
    """One rank-based score: where the bins end is a function of the row count."""

    name: str
    value: str
    ends: Callable[[int], list[int]]  # last row position of every bin but the last
    descending: bool = False

    def signed(self) -> Column:
        value = F.col(self.value).cast("double")
        return -value if self.descending else value


def add_scores(base: DataFrame, tie: str, scores: Sequence[Score]) -> DataFrame:
    """Label every row with its rank bin, without ranking the whole table.

    ``base`` must be staged and its score columns non-null. Only the rows at the bin ends
    are located; the labels are then a projection with literal comparisons.
    """
    ranked = base.select(F.col(tie).alias("_t"), *[s.signed().alias(f"_v{i}") for i, s in enumerate(scores)])
    *value_cuts, tie_cuts = cut_points(ranked, [f"_v{i}" for i in range(len(scores))] + ["_t"], bucket_count(base))
    entries = F.array(*[F.struct(F.lit(i).alias("_spec"), F.col(f"_v{i}").alias("_v")) for i in range(len(scores))])
    long = ranked.select("_t", F.inline(entries)).withColumn("_w", F.lit(1))
    found = locate(long, {i: (c, tie_cuts) for i, c in enumerate(value_cuts)}, lambda i, n: scores[i].ends(n))
    columns = []
    for i, score in enumerate(scores):
        label = F.lit(1)
        n, rows = found.get(i, (0, {}))
        for position in score.ends(n):
            if position < 1:  # the bin below is empty
                label = label + F.lit(1)
            elif position in rows:
                v, t = (F.lit(x) for x in rows[position])
                label = label + ((score.signed() > v) | ((score.signed() == v) & (F.col(tie) > t))).cast("int")
        columns.append(label.alias(score.name))
    return base.select("*", *columns)


def percentile_score_ends(n: int) -> list[int]:
    """Ends of bins 1..4 of ``ceil(5 r / n)``."""
    return [floor(k * n / 5) for k in range(1, 5)]


def reversed_percentile_score_ends(n: int) -> list[int]:
    """Last ranks r where ``ceil(5 (n - r) / n)`` is still above 4, 3, 2 and 1."""
    return [n - floor(k * n / 5) - 1 for k in range(4, 0, -1)]


def quintile_ends(n: int) -> list[int]:
    """Ends of bins 1..4 of equal-frequency quintiles over ranks, edges interpolated:
    ``max(1, ceil(5 (r - 1) / (n - 1)))``."""
    return [1 + floor(k * (n - 1) / 5) for k in range(1, 5)]


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], limit: int = PERCENTILE_MAP_LIMIT) -> DataFrame:
    """One row; ``columns`` become arrays of exact, linearly interpolated quantiles.

    Nulls are skipped and an all-null column gives null. The input is read once, into
    value counts combined map-side. A column with at most ``limit`` distinct values then
    takes the built-in percentile over its counts; a larger one is searched by bucket, so
    no task holds all of its values.
    """
    columns, probabilities = list(columns), list(probabilities)
    counted = _value_counts(df, columns)
    buckets = bucket_count(counted)
    probes = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    sizes = counted.groupBy("_spec").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", probes, 4 * buckets).alias("cuts"))
    found: dict[int, list[float]] = {}
    large: dict[int, tuple[Sequence[float], Sequence[float]]] = {}
    small: list[int] = []
    for row in sizes.collect():
        if row["n"] > limit:
            large[row["_spec"]] = (sorted(set(row["cuts"])), [])
        else:
            small.append(row["_spec"])
    if small:
        exact = F.percentile("_v", F.array(*map(F.lit, probabilities)), F.col("_w"))
        for row in counted.where(F.col("_spec").isin(small)).groupBy("_spec").agg(exact.alias("q")).collect():
            found[row["_spec"]] = row["q"]
    if large:
        found |= _searched(counted.where(F.col("_spec").isin(list(large))), large, probabilities)
    literals = [
        F.array(*[F.lit(v) for v in found[i]]) if i in found else F.lit(None).cast("array<double>") for i in range(len(columns))
    ]
    return df.sparkSession.range(1).select(*[v.alias(c) for v, c in zip(literals, columns)])


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Staged (_spec, _v, _w, _t): how often every value of every column occurs."""
    entries = F.array(*[F.struct(F.lit(i).alias("_spec"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)])
    counts = df.select(F.inline(entries)).where(F.col("_v").isNotNull()).groupBy("_spec", "_v").agg(F.count(F.lit(1)).alias("_w"))
    return stage(counts.withColumn("_t", F.lit(0)), "values")


def _searched(counted: DataFrame, cuts, probabilities: Sequence[float]) -> dict[int, list[float]]:
    def spots(n: int) -> list[tuple[int, int, float]]:
        at = [(n - 1) * p for p in probabilities]
        return [(floor(x) + 1, min(n, floor(x) + 2), x - floor(x)) for x in at]

    located = locate(counted, cuts, lambda _, n: sorted({p for low, high, _ in spots(n) for p in (low, high)}))
    return {
        spec: [rows[low][0] + (rows[high][0] - rows[low][0]) * part for low, high, part in spots(n)] for spec, (n, rows) in located.items()
    }


def medians(df: DataFrame, columns: Sequence[str], suffix: str = "_median") -> DataFrame:
    """One row of exact medians, named ``<column><suffix>``."""
    found = quantiles(df, columns, [0.5])
    return found.select(*[F.col(c)[0].alias(f"{c}{suffix}") for c in columns])
