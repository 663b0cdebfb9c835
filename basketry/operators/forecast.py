"""Forecast models on pooled period tables, fitted with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions.scalars import attach_row
from basketry.operators.ridge import predicted
from basketry.operators.series import WEEKLY_FEATURES, expanding_folds, with_abs_error
from basketry.session import keep_lineage_short, stage


def assemble(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=name, handleInvalid="error").transform(df)


def with_series_code(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add one numeric code for the series, so that one pooled model can tell series apart."""
    if not keys:
        return df, []
    label = df.withColumn("_series", F.concat_ws("|", *keys))
    return StringIndexer(inputCol="_series", outputCol="series_code").fit(label).transform(label).drop("_series"), ["series_code"]


def standardised(train: DataFrame, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Scale features by the mean and population deviation of ``train`` (two numbers each)."""
    stats = train.agg(*[F.struct(F.avg(c), F.stddev_pop(c)).alias(c) for c in features]).first()
    return df.withColumns({c: (F.col(c) - F.lit(stats[c][0])) / F.lit(stats[c][1] or 1.0) for c in features})


def fit_linear(train: DataFrame, features: Sequence[str], label: str = "target"):
    """Ordinary least squares."""
    return LinearRegression(labelCol=label, solver="normal", regParam=0.0).fit(assemble(train, features))


def fit_ridge(train: DataFrame, features: Sequence[str], label: str = "target", alpha: float = 1.0):
    """Ridge with the usual sum-of-squares penalty ``alpha``.

    Spark divides the loss by the row count and scales the label by its deviation, so its
    regParam is alpha * sd(label) / n.
    """
    n, deviation = train.agg(F.count(label), F.stddev_pop(label)).first()
    model = LinearRegression(
        labelCol=label, solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha * (deviation or 0.0) / n
    )
    return model.fit(assemble(train, features))


def coefficient_table(model, features: Sequence[str], spark) -> DataFrame:
    """Feature and coefficient, largest first."""
    rows = [(f, float(c), abs(float(c))) for f, c in zip(features, model.coefficients)]
    return spark.createDataFrame(rows, "feature string, coefficient double, importance double").orderBy(F.desc("coefficient"))


def _predict(model, df: DataFrame, features: Sequence[str], name: str, keep: Sequence[str]) -> DataFrame:
    return model.transform(assemble(df, features)).select(*keep, F.col("prediction").alias(name))


def out_of_fold(
    table: DataFrame, features: Sequence[str], models: Sequence[str], keys: Sequence[str] = (), folds: int = 5, trees: int = 300,
    reduced: Sequence[str] | None = None,
) -> DataFrame:
    """Out-of-fold predictions of the named models side by side, one column each.

    Models: linear, scaled_linear, ridge (standardised, on ``reduced`` if given), tree, forest.
    """
    coded, extra = with_series_code(table, keys)
    folded = stage(expanding_folds(coded, "date", keys, folds), "folds")
    features = [*features, *extra]
    ridge_features = [*reduced, *extra] if reduced else features
    parts = []
    for fold in range(1, folds + 1):
        train, test = folded.where(F.col("fold") < fold), folded.where(F.col("fold") == fold)
        id_columns = [*keys, "date", "fold", "target"]
        out = test.select(*id_columns)
        for name in models:
            used = ridge_features if name == "ridge" else features
            fit_on, apply_to = train, test
            if name in ("scaled_linear", "ridge"):
                fit_on, apply_to = standardised(train, train, used), standardised(train, test, used)
            if name in ("linear", "scaled_linear"):
                model = fit_linear(fit_on, used)
            elif name == "ridge":
                model = fit_ridge(fit_on, used)
            elif name == "tree":
                model = DecisionTreeRegressor(labelCol="target", maxDepth=4, seed=42).fit(assemble(fit_on, used))
            else:
                model = RandomForestRegressor(labelCol="target", numTrees=trees, maxDepth=5, seed=42).fit(assemble(fit_on, used))
            predicted = _predict(model, apply_to, used, f"{name}_pred", [*keys, "date"])
            out = out.join(predicted, [*keys, "date"])
        parts.append(out)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def boosted_forecast(
    table: DataFrame, features: Sequence[str], label: str, rounds: int = 600, step: float = 0.04, log_target: bool = False,
    keep: Sequence[str] = ("order_date",),
) -> DataFrame:
    """Gradient-boosted trees fitted on ``is_train`` rows, applied to the rest.

    With ``log_target`` the label is log1p of the measure: predictions are turned back and
    kept at or above zero.
    """
    keep_lineage_short(table.sparkSession)
    data = assemble(table, features)
    model = GBTRegressor(labelCol=label, maxDepth=6, stepSize=step, maxIter=rounds, seed=42).fit(data.where("is_train"))
    scored = model.transform(data.where("NOT is_train"))
    value = F.greatest(F.expm1("prediction"), F.lit(0.0)) if log_target else F.col("prediction")
    return scored.select(*keep, F.col("prediction").alias("raw_prediction"), value.alias("predicted"))


def revenue_forecast(table: DataFrame, features: Sequence[str], rounds: int = 600) -> DataFrame:
    """Actual and predicted revenue of the validation days with the absolute error."""
    out = boosted_forecast(table, features, "revenue_log", rounds, 0.04, True, ["order_date", "revenue", "orders_cnt", "revenue_log"])
    return with_abs_error(out, "revenue", "predicted")


def orders_forecast(table: DataFrame, features: Sequence[str], rounds: int = 400) -> DataFrame:
    """Actual and predicted order counts of the validation days with the absolute error."""
    return with_abs_error(boosted_forecast(table, features, "orders_cnt", rounds, 0.05, False, ["order_date", "orders_cnt"]), "orders_cnt", "predicted")


def daily_features(table: DataFrame) -> list[str]:
    """Model inputs of a daily table: everything but dates, targets and same-day measures."""
    left_out = {"order_date", "revenue", "revenue_log", "profit", "orders_cnt", "users_cnt", "items_cnt", "is_train"}
    return [c for c in table.columns if c not in left_out]


def recent_history(weekly: DataFrame, measure: str = "items", keys: Sequence[str] = (), length: int = 12) -> DataFrame:
    """Per series: the last ``length`` values as an array, the week count and the last week.

    Fails for a series with fewer weeks.
    """
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("date")))
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    recent = weekly.select(*keys, "date", F.col(measure).cast("double").alias("_y"), newest.alias("_place"), count.alias("_n"))
    packed = recent.where(F.col("_place") <= length).groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("date", "_y"))), lambda s: s["_y"]).alias("_history"),
        F.first("_n").alias("_n"),
        F.max("date").alias("_last"),
    )
    message = F.lit(f"a forecast needs at least {length} weeks of history")
    checked = F.when(F.size("_history") < length, F.raise_error(message).cast("array<double>")).otherwise(F.col("_history"))
    return packed.withColumn("_history", checked)


def _weekly_inputs(history: Column, date: Column, index: Column) -> dict[str, Column]:
    def mean_of(n: int) -> Column:
        return F.aggregate(F.slice(history, -n, n), F.lit(0.0), lambda a, x: a + x) / n

    return {
        "lag_1": F.element_at(history, -1),
        "lag_4": F.element_at(history, -4),
        "lag_12": F.element_at(history, -12),
        "rolling_mean_4": mean_of(4),
        "rolling_mean_12": mean_of(12),
        "month": F.month(date).cast("double"),
        "quarter": F.quarter(date).cast("double"),
        "time_idx": index.cast("double"),
    }


def next_week_features(weekly: DataFrame, measure: str = "items", keys: Sequence[str] = ()) -> DataFrame:
    """Model inputs of the week after the last one."""
    recent = recent_history(weekly, measure, keys)
    date = F.date_add("_last", 7)
    inputs = _weekly_inputs(F.col("_history"), date, F.col("_n"))
    return recent.select(*keys, date.alias("date"), *[col.alias(name) for name, col in inputs.items()])


def with_fits(df: DataFrame, fits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a series beside its fit; without keys there is one fit."""
    return df.join(fits, list(keys)) if keys else attach_row(df, fits)


def next_week_forecast(fits: DataFrame, weekly: DataFrame, measure: str = "items", keys: Sequence[str] = ()) -> DataFrame:
    """The week after the last one by ridge_by_series() on the weekly features."""
    found = with_fits(next_week_features(weekly, measure, keys), fits, keys)
    return found.select(*keys, "date", predicted(WEEKLY_FEATURES).alias("predicted_items_next_week"))


def recursive_forecast(fits: DataFrame, weekly: DataFrame, horizon: int = 8, measure: str = "items", keys: Sequence[str] = ()) -> DataFrame:
    """Forecast week by week, each prediction feeding the next one's lags and means.

    ``fits`` are those of ridge_by_series() on the weekly features, one for each series. The recursion is an array fold
    inside the row of its series: the last twelve values go in, ``horizon`` predictions come out. The time index goes on
    from the full history.
    """

    def step(history: Column, i: Column) -> Column:
        date = F.date_add(F.col("_last"), (i * 7).cast("int"))
        inputs = _weekly_inputs(history, date, F.col("_n") + i - 1)
        value = F.col("intercept")
        for j, name in enumerate(WEEKLY_FEATURES):
            value = value + F.col("weights")[j] * (inputs[name] - F.col("middle")[j]) / F.col("scale")[j]
        return F.concat(history, F.array(value))

    recent = with_fits(recent_history(weekly, measure, keys), fits, keys)
    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("_history"), step)
    ahead = recent.select(*keys, "_last", F.posexplode(F.slice(path, -horizon, horizon)).alias("_i", "forecast_items"))
    return ahead.select(*keys, F.date_add("_last", ((F.col("_i") + 1) * 7).cast("int")).alias("date"), "forecast_items")
