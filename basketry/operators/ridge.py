"""Ridge regression of every series by itself, all series and folds in one aggregation.

A series' means, deviations and covariances come from one map-side aggregate; its small system of equations is solved in its
row by elimination, as array expressions. Nothing is gathered, and no model is fitted by a loop over series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _solved(matrix: Column, size: int) -> Column:
    """Solution of a system given as rows with the right side at the end; the left side is positive definite."""

    def step(rows: Column, k: Column) -> Column:
        pivot = F.element_at(rows, k)
        unit = F.transform(pivot, lambda x: x / F.element_at(pivot, k))
        return F.transform(
            rows, lambda row, i: F.when(i + 1 == k, unit).otherwise(F.zip_with(row, unit, lambda x, u: x - F.element_at(row, k) * u))
        )

    done = F.aggregate(F.sequence(F.lit(1), F.lit(size)), matrix, step)
    return F.transform(done, lambda row: F.element_at(row, -1))


def ridge_by_series(table: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "target", alpha: float = 1.0, scaled: bool = True) -> DataFrame:
    """(keys, rows, middle, scale, weights, intercept): the ridge fit of each series of ``table``.

    The penalty is ``alpha`` on the sum of squares of the weights, not on the intercept. ``scaled`` fits on features less
    their mean and divided by their population deviation (1 for a constant one); else ``scale`` is 1 and weights are on the
    plain features. A prediction is intercept + sum of weights * (x - middle) / scale. Rows with a null label or feature are
    left out; a series without other rows has no fit.
    """
    p = len(features)
    x = [F.col(f"`{c}`").cast("double") for c in features]
    y = F.col(f"`{label}`").cast("double")
    whole = F.lit(True)
    for c in [*x, y]:
        whole = whole & c.isNotNull()
    sums = [F.count("*").alias("rows"), F.avg(y).alias("_y"), F.array(*[F.avg(c) for c in x]).alias("middle"), F.array(*[F.stddev_pop(c) for c in x]).alias("_sd")]
    pairs = [F.covar_pop(x[i], x[j]).alias(f"_c{i}_{j}") for i in range(p) for j in range(i, p)]
    sums += [*pairs, *[F.covar_pop(x[i], y).alias(f"_r{i}") for i in range(p)]]
    moments = table.where(whole).groupBy(*keys).agg(*sums) if keys else table.where(whole).agg(*sums).where("rows > 0")
    scale = F.transform("_sd", lambda s: F.when(s > 0, s).otherwise(1.0)) if scaled else F.array(*[F.lit(1.0)] * p)
    moments = moments.withColumn("scale", scale)
    at = lambda i: F.col("scale")[i]
    n = F.col("rows")

    def row(i: int) -> Column:
        left = [n * F.col(f"_c{min(i, j)}_{max(i, j)}") / (at(i) * at(j)) + (alpha if i == j else 0.0) for j in range(p)]
        return F.array(*left, n * F.col(f"_r{i}") / at(i))

    fitted = moments.withColumn("weights", _solved(F.array(*[row(i) for i in range(p)]), p))
    return fitted.select(*keys, "rows", "middle", "scale", "weights", F.col("_y").alias("intercept"))


def predicted(features: Sequence[str]) -> Column:
    """The prediction for a row that holds its features and the columns of ridge_by_series()."""
    value = F.col("intercept")
    for j, c in enumerate(features):
        value = value + F.col("weights")[j] * (F.col(f"`{c}`").cast("double") - F.col("middle")[j]) / F.col("scale")[j]
    return value


def ridge_out_of_fold(folded: DataFrame, keys: Sequence[str], features: Sequence[str], folds: int = 5, label: str = "target", alpha: float = 1.0, scaled: bool = True, name: str = "ridge_pred") -> DataFrame:
    """The rows of ``folded`` (keys, date, fold, label, features) of folds 1 to ``folds`` with a prediction each.

    Fold f is predicted from the folds before it, 0 included. Each row enters the sums of all later folds, so that one
    aggregation gives all fits. A series without earlier rows has NULL.
    """
    later = folded.where(F.col("fold") < folds).withColumn("_fold", F.explode(F.sequence(F.col("fold").cast("int") + 1, F.lit(folds))))
    fits = ridge_by_series(later, [*keys, "_fold"], features, label, alpha, scaled)
    test = folded.where(F.col("fold") > 0).withColumn("_fold", F.col("fold").cast("int"))
    return test.join(fits, [*keys, "_fold"], "left").select(*keys, "date", "fold", label, predicted(features).alias(name))


def coefficients(fits: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keys, feature, coefficient) of ridge_by_series()."""
    named = F.array(*[F.lit(c) for c in features])
    return fits.select(*keys, F.explode(F.arrays_zip(named.alias("feature"), F.col("weights").alias("coefficient"))).alias("_f")).select(
        *keys, F.col("_f.feature").alias("feature"), F.col("_f.coefficient").alias("coefficient")
    )
