"""Time-series and forecast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketry.operators import forecast as fc
from basketry.operators import sales as sa
from basketry.operators import ridge as rg
from basketry.operators import series as se
from basketry.plans.catalog import query, view
from basketry.plans.customers_queries import sales
from basketry.plans.marts_queries import full_days
from basketry.session import stage
from basketry.sources.tables import order_items

view("outlook_months", "SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, sum(sale_price) AS revenue FROM order_items GROUP BY 1")


@query(
    "i01_sales_outlook",
    "month:s forecast_revenue:f method:s",
    """
WITH r AS (SELECT *, row_number() OVER (ORDER BY month DESC) AS p FROM outlook_months),
  c AS (SELECT *, revenue - lag(revenue) OVER (ORDER BY month) AS change FROM r WHERE p <= 6),
  s AS (SELECT max(month) AS last, avg(revenue) FILTER (p <= 3) AS base, coalesce(avg(change) FILTER (p <= 3), 0) AS trend FROM c)
SELECT strftime(last + to_months(CAST(k AS INTEGER)), '%Y-%m') AS month, greatest(base + trend * k, 0) AS forecast_revenue,
  'last_3_month_average_plus_short_trend' AS method FROM s, (SELECT unnest(range(1, 4)) AS k)
""",
)
def i01(spark, d):
    return se.sales_outlook(se.monthly_revenue(order_items(spark, d, "created_at", "sale_price")))


@query(
    "i01_sales_outlook_by_category",
    "category:s month:s forecast_revenue:f",
    """
WITH m AS (SELECT category, CAST(date_trunc('month', created_at) AS DATE) AS month, sum(sale_price) AS revenue FROM order_items GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY month DESC) AS p FROM m),
  c AS (SELECT *, revenue - lag(revenue) OVER (PARTITION BY category ORDER BY month) AS change FROM r WHERE p <= 6),
  s AS (SELECT category, max(month) AS last, avg(revenue) FILTER (p <= 3) AS base, coalesce(avg(change) FILTER (p <= 3), 0) AS trend FROM c GROUP BY category)
SELECT category, strftime(last + to_months(CAST(k AS INTEGER)), '%Y-%m') AS month, greatest(base + trend * k, 0) AS forecast_revenue
FROM s, (SELECT unnest(range(1, 4)) AS k)
""",
)
def i01_by_category(spark, d):
    lines = order_items(spark, d, "category", "created_at", "sale_price")
    return se.sales_outlook(se.monthly_revenue(lines, ["category"]), ["category"])


view(
    "day_sales",
    "SELECT order_date, sum(line_revenue) AS revenue, sum(line_profit) AS profit, count(DISTINCT order_id) AS orders_cnt, "
    "count(DISTINCT user_id) AS users_cnt, sum(num_of_item) AS items_cnt FROM sales GROUP BY order_date",
)
view(
    "day_features",
    "SELECT *, isodow(order_date) - 1 AS day_of_week_num, month(order_date) AS month_num, weekofyear(order_date) AS week_num, "
    "CAST(isodow(order_date) >= 6 AS INTEGER) AS is_weekend, day(order_date) AS day_of_month, "
    "row_number() OVER (ORDER BY order_date) - 1 AS time_idx, ln(1 + revenue) AS revenue_log FROM day_sales",
)
_DAY_SPEC = "order_date:d revenue:f orders_cnt:i day_of_week_num:i month_num:i week_num:i is_weekend:i day_of_month:i time_idx:i revenue_log:f"


def day_sales(spark, d):
    return sa.daily_sales(sales(spark, d, "order_id", "user_id"))


@query("i02_calendar_features", _DAY_SPEC, "SELECT * FROM day_features")
def i02(spark, d):
    return se.calendar_features(day_sales(spark, d))


_TARGETS = ["revenue", "orders_cnt", "revenue_log"]
_LAG_NAMES = [f"{t}_lag_{n}" for t in _TARGETS for n in (1, 7, 14, 28)]
_ROLL_NAMES = [f"{t}_roll_{s}_{n}" for t in _TARGETS for n in (7, 14, 28) for s in ("mean", "std")]
view(
    "day_model",
    "SELECT * FROM (SELECT *, "
    + ", ".join(f"lag({t}, {n}) OVER (ORDER BY order_date) AS {t}_lag_{n}" for t in _TARGETS for n in (1, 7, 14, 28))
    + ", "
    + ", ".join(
        f"{fn}({t}) OVER (ORDER BY order_date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS {t}_roll_{s}_{n}"
        for t in _TARGETS
        for n in (7, 14, 28)
        for s, fn in (("mean", "avg"), ("std", "stddev_samp"))
    )
    + " FROM day_features) WHERE time_idx >= 28",
)


@query(
    "i03_daily_model_table",
    _DAY_SPEC + " " + " ".join(f"{n}:f" for n in [*_LAG_NAMES, *_ROLL_NAMES]),
    "SELECT * FROM day_model",
)
def i03(spark, d):
    return se.daily_model_table(day_sales(spark, d))


def _period_view(name, source, lags, windows):
    columns = [f"lag(target, {n}) OVER (ORDER BY date) AS lag_{n}" for n in lags]
    columns += [f"avg(target) OVER (ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) AS rolling_mean_{n}" for n in windows]
    longest = max([*lags, *windows])
    view(
        name,
        f"SELECT * FROM (SELECT date, target, month(date) AS month, quarter(date) AS quarter, row_number() OVER (ORDER BY date) - 1 AS time_idx, "
        f"{', '.join(columns)} FROM (SELECT date, CAST(items AS DOUBLE) AS target FROM {source})) WHERE time_idx >= {longest}",
    )


_period_view("month_model", "month_series", [1, 2, 3, 6], [3, 6])
_period_view("week_model", "week_series", [1, 4, 12], [4, 12])


def month_model(spark, d):
    return se.monthly_model_table(sa.resample(full_days(spark, d), "month"))


def week_series(spark, d):
    return sa.resample(full_days(spark, d), "week")


def week_model(spark, d):
    return se.weekly_model_table(week_series(spark, d))


_MONTH_SPEC = "date:d target:f " + " ".join(f"{c}:f" for c in se.MONTHLY_FEATURES)
_WEEK_SPEC = "date:d target:f " + " ".join(f"{c}:f" for c in se.WEEKLY_FEATURES)


@query("i04_monthly_model_table", _MONTH_SPEC, "SELECT * FROM month_model")
def i04(spark, d):
    return month_model(spark, d)


@query("i05_weekly_model_table", _WEEK_SPEC, "SELECT * FROM week_model")
def i05(spark, d):
    return week_model(spark, d)


@query(
    "i05_weekly_model_by_state",
    "state:s " + _WEEK_SPEC,
    """
WITH s AS (SELECT state, CAST(created_at AS DATE) AS date, count(*) AS items FROM order_items WHERE status <> 'Cancelled' GROUP BY ALL),
  g AS (SELECT state, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM s GROUP BY state),
  w AS (SELECT state, CAST(date_trunc('week', date) AS DATE) + 6 AS date, CAST(sum(coalesce(items, 0)) AS DOUBLE) AS target FROM g LEFT JOIN s USING (state, date) GROUP BY ALL)
SELECT * FROM (SELECT *, month(date) AS month, quarter(date) AS quarter, row_number() OVER o - 1 AS time_idx, lag(target, 1) OVER o AS lag_1,
  lag(target, 4) OVER o AS lag_4, lag(target, 12) OVER o AS lag_12,
  avg(target) OVER (PARTITION BY state ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rolling_mean_4,
  avg(target) OVER (PARTITION BY state ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS rolling_mean_12
  FROM w WINDOW o AS (PARTITION BY state ORDER BY date)) WHERE time_idx >= 12
""",
)
def i05_by_state(spark, d):
    weekly = sa.resample(full_days(spark, d, ["state"]), "week", ["state"])
    return se.weekly_model_table(weekly, keys=["state"])


view(
    "day_split",
    "SELECT *, date_diff('day', DATE '1970-01-01', order_date) <= quantile_cont(date_diff('day', DATE '1970-01-01', order_date), 0.85) OVER () AS is_train FROM day_model",
)


@query("i06_date_split", "order_date:d revenue:f is_train:b", "SELECT order_date, revenue, is_train FROM day_split")
def i06(spark, d):
    return se.date_split(se.daily_model_table(day_sales(spark, d)))


view(
    "month_folds",
    "SELECT *, CASE WHEN row_idx >= n - 5 * (n // 6) THEN (row_idx - (n - 5 * (n // 6))) // (n // 6) + 1 ELSE 0 END AS fold FROM "
    "(SELECT *, row_number() OVER (ORDER BY date) - 1 AS row_idx, count(*) OVER () AS n FROM month_model)",
)


@query("i07_expanding_folds", "date:d target:f row_idx:i fold:i", "SELECT date, target, row_idx, fold FROM month_folds")
def i07(spark, d):
    return se.expanding_folds(month_model(spark, d))


@query(
    "i08_naive_fold_error",
    "fold:i mae:f",
    "SELECT fold, avg(abs(target - lag_1)) AS mae FROM month_folds WHERE fold > 0 GROUP BY fold",
)
def i08(spark, d):
    return se.naive_fold_error(se.expanding_folds(month_model(spark, d)))


@query("i09_model_comparison", "date:d fold:i target:f linear_pred:f scaled_linear_pred:f tree_pred:f forest_pred:f")
def i09(spark, d):
    models = ["linear", "scaled_linear", "tree", "forest"]
    return fc.out_of_fold(month_model(spark, d), se.MONTHLY_FEATURES, models)


@query("i10_ridge_out_of_fold", "date:d fold:i target:f linear_pred:f ridge_pred:f")
def i10(spark, d):
    return fc.out_of_fold(month_model(spark, d), se.MONTHLY_FEATURES, ["linear", "ridge"], reduced=se.REDUCED_FEATURES)


def _ridge_sql(source, keys, features, scaled=True, folds=True):
    """CTE ``fit`` (keys, f, middle, scale, weights, intercept) over ``source``, by elimination on the normal equations."""
    p = len(features)
    key = [*keys, "f"]
    on = " AND ".join([*[f"o.{k} = s.{k}" for k in keys], "s.fold < o.f"]) if folds else " AND ".join([f"o.{k} = s.{k}" for k in keys] or ["true"])
    groups = f"SELECT DISTINCT {', '.join([*keys, 'fold AS f'])} FROM {source} WHERE fold > 0" if folds else f"SELECT DISTINCT {', '.join([*keys, '0 AS f'])} FROM {source}"
    scale = [f"CASE WHEN stddev_pop(s.{c}) > 0 THEN stddev_pop(s.{c}) ELSE 1 END" if scaled else "1.0" for c in features]
    rows = ", ".join(
        "[" + ", ".join([f"n * c{min(i, j)}_{max(i, j)} / (scale[{i + 1}] * scale[{j + 1}]) + {1 if i == j else 0}.0" for j in range(p)] + [f"n * r{i} / scale[{i + 1}]"]) + "]"
        for i in range(p)
    )
    covariances = ", ".join([f"covar_pop(s.{features[i]}, s.{features[j]}) AS c{i}_{j}" for i in range(p) for j in range(i, p)] + [f"covar_pop(s.{c}, s.target) AS r{i}" for i, c in enumerate(features)])
    return f"""
WITH RECURSIVE o AS ({groups}),
  m AS (SELECT {", ".join("o." + k for k in key)}, count(*) AS n, avg(s.target) AS intercept, [{", ".join(f"avg(s.{c})" for c in features)}] AS middle,
    [{", ".join(scale)}] AS scale, {covariances} FROM o JOIN {source} s ON {on} GROUP BY {", ".join("o." + k for k in key)}),
  e AS (SELECT {", ".join(key)}, 1 AS k, [{rows}] AS mat FROM m
    UNION ALL SELECT {", ".join(key)}, k + 1, list_transform(mat, lambda row, i: CASE WHEN i = k THEN list_transform(mat[k], lambda x: x / mat[k][k])
      ELSE list_transform(row, lambda x, j: x - row[k] * (mat[k][j] / mat[k][k])) END) FROM e WHERE k <= {p}),
  fit AS (SELECT m.*, list_transform(mat, lambda row: row[{p + 1}]) AS weights FROM m JOIN e ON {" AND ".join(f"e.{k} = m.{k}" for k in key)} WHERE k = {p + 1})"""


def _predicted_sql(features, row="t."):
    return " + ".join(["intercept", *[f"weights[{j + 1}] * ({row}{c} - middle[{j + 1}]) / scale[{j + 1}]" for j, c in enumerate(features)]])


def _oof_sql(source, keys, features):
    on = " AND ".join([*[f"fit.{k} = t.{k}" for k in keys], "fit.f = t.fold"])
    return f"{_ridge_sql(source, keys, features)} SELECT t.*, {_predicted_sql(features)} AS ridge_pred FROM {source} t LEFT JOIN fit ON {on} WHERE t.fold > 0"


@query("i10_monthly_ridge", "date:d fold:i target:f ridge_pred:f", _oof_sql("month_folds", [], se.REDUCED_FEATURES))
def i10_monthly(spark, d):
    """Out-of-fold ridge predictions of the monthly table, the fits of all folds from one aggregation."""
    return rg.ridge_out_of_fold(stage(se.expanding_folds(month_model(spark, d)), "folds"), [], se.REDUCED_FEATURES)


view(
    "state_weeks",
    """
WITH s AS (SELECT state, CAST(created_at AS DATE) AS date, count(*) AS items FROM order_items WHERE status <> 'Cancelled' GROUP BY ALL),
  g AS (SELECT state, unnest(generate_series(min(date)::TIMESTAMP, max(date)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS date FROM s GROUP BY state)
SELECT state, CAST(date_trunc('week', date) AS DATE) + 6 AS date, CAST(sum(coalesce(items, 0)) AS DOUBLE) AS target FROM g LEFT JOIN s USING (state, date) GROUP BY ALL
""",
)
view(
    "state_week_model",
    """
SELECT * FROM (SELECT *, month(date) AS month, quarter(date) AS quarter, row_number() OVER o - 1 AS time_idx, lag(target, 1) OVER o AS lag_1,
  lag(target, 4) OVER o AS lag_4, lag(target, 12) OVER o AS lag_12,
  avg(target) OVER (PARTITION BY state ORDER BY date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS rolling_mean_4,
  avg(target) OVER (PARTITION BY state ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS rolling_mean_12
  FROM state_weeks WINDOW o AS (PARTITION BY state ORDER BY date)) WHERE time_idx >= 12
""",
)
view(
    "state_week_folds",
    "SELECT *, CASE WHEN i >= n - 5 * (n // 6) THEN (i - (n - 5 * (n // 6))) // (n // 6) + 1 ELSE 0 END AS fold FROM "
    "(SELECT *, row_number() OVER (PARTITION BY state ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY state) AS n FROM state_week_model)",
)


@query("i10_weekly_ridge_by_state", "state:s date:d fold:i target:f ridge_pred:f", _oof_sql("state_week_folds", ["state"], se.WEEKLY_FEATURES))
def i10_by_state(spark, d):
    """Out-of-fold predictions of every state by a ridge of its own."""
    weekly = sa.resample(full_days(spark, d, ["state"]), "week", ["state"])
    folded = stage(se.expanding_folds(se.weekly_model_table(weekly, keys=["state"]), "date", ["state"]), "folds")
    return rg.ridge_out_of_fold(folded, ["state"], se.WEEKLY_FEATURES)


@query(
    "i11_ridge_coefficients",
    "feature:s coefficient:f",
    _ridge_sql("month_model", [], se.REDUCED_FEATURES, folds=False)
    + f" SELECT unnest([{', '.join(repr(c) for c in se.REDUCED_FEATURES)}]) AS feature, unnest(weights) AS coefficient FROM fit",
)
def i11_ridge(spark, d):
    """Standardised ridge coefficients of the monthly table."""
    return rg.coefficients(rg.ridge_by_series(month_model(spark, d), [], se.REDUCED_FEATURES), [], se.REDUCED_FEATURES)


@query("i11_coefficients", "feature:s coefficient:f")
def i11(spark, d):
    table = stage(month_model(spark, d), "months")
    scaled = fc.standardised(table, table, se.MONTHLY_FEATURES)
    return fc.coefficient_table(fc.fit_linear(scaled, se.MONTHLY_FEATURES), se.MONTHLY_FEATURES, spark)


def day_split(spark, d):
    return stage(se.date_split(se.daily_model_table(day_sales(spark, d))), "days")


@query("i12_boosted_revenue", "order_date:d revenue:f predicted:f abs_error:f")
def i12_revenue(spark, d):
    table = day_split(spark, d)
    return fc.revenue_forecast(table, fc.daily_features(table))


@query("i12_boosted_orders", "order_date:d orders_cnt:i predicted:f abs_error:f")
def i12_orders(spark, d):
    table = day_split(spark, d)
    return fc.orders_forecast(table, fc.daily_features(table))


@query(
    "i13_error_measures",
    "mae:f rmse:f wape:f",
    "SELECT avg(abs(target - rolling_mean_4)) AS mae, sqrt(avg((target - rolling_mean_4) ** 2)) AS rmse, "
    "sum(abs(target - rolling_mean_4)) / sum(abs(target)) AS wape FROM week_model",
)
def i13(spark, d):
    return se.error_measures(week_model(spark, d), "target", "rolling_mean_4")


@query(
    "i14_actual_vs_predicted",
    "date:d target:f predicted:f abs_error:f",
    "SELECT date, target, rolling_mean_12 AS predicted, abs(target - rolling_mean_12) AS abs_error FROM week_model",
)
def i14(spark, d):
    return se.with_abs_error(week_model(spark, d).withColumn("predicted", F.col("rolling_mean_12")), "target", "predicted")


def weekly_ridge(spark, d, keys=()):
    weekly = stage(sa.resample(full_days(spark, d, keys), "week", keys), "weeks")
    return stage(rg.ridge_by_series(se.weekly_model_table(weekly, keys=keys), keys, se.WEEKLY_FEATURES, scaled=False), "fits"), weekly


def _ahead_sql(weeks, model, keys, horizon):
    """The next weeks of every series, each from the list of values so far."""
    by = f"PARTITION BY {', '.join(keys)} " if keys else ""
    lead = "".join(f"{k}, " for k in keys)
    join = " AND ".join(f"fit.{k} = h.{k}" for k in keys) or "true"
    mean = lambda n: f"list_avg(v[-{n}:])"
    inputs = {
        "lag_1": "v[-1]", "lag_4": "v[-4]", "lag_12": "v[-12]", "rolling_mean_4": mean(4), "rolling_mean_12": mean(12), "month": "month(day + 7)",
        "quarter": "quarter(day + 7)", "time_idx": "len(v)",
    }
    value = " + ".join(["intercept", *[f"weights[{j + 1}] * ({inputs[c]} - middle[{j + 1}]) / scale[{j + 1}]" for j, c in enumerate(se.WEEKLY_FEATURES)]])
    return f"""{_ridge_sql(model, keys, se.WEEKLY_FEATURES, scaled=False, folds=False)},
  h AS (SELECT {lead}list(target ORDER BY date) AS v, max(date) AS day FROM {weeks} GROUP BY {", ".join(keys) or "()"}),
  ahead AS (SELECT {"".join(f"h.{k}, " for k in keys)}0 AS i, v, day, intercept, weights, middle, scale FROM h JOIN fit ON {join}
    UNION ALL SELECT {lead}i + 1, list_append(v, {value}), CAST(day + 7 AS DATE), intercept, weights, middle, scale FROM ahead WHERE i < {horizon})
SELECT {lead}day AS date, v[-1] AS forecast_items, v[-1] AS predicted_items_next_week FROM ahead WHERE i > 0"""


view("week_targets", "SELECT date, CAST(items AS DOUBLE) AS target FROM week_series")


@query("i15_recursive_forecast", "date:d forecast_items:f", _ahead_sql("week_targets", "week_model", [], 8))
def i15(spark, d):
    fits, weekly = weekly_ridge(spark, d)
    return fc.recursive_forecast(fits, weekly)


@query("i15_recursive_forecast_by_state", "state:s date:d forecast_items:f", _ahead_sql("state_weeks", "state_week_model", ["state"], 8))
def i15_by_state(spark, d):
    """Eight weeks of every state from its own ridge and its own history."""
    fits, weekly = weekly_ridge(spark, d, ["state"])
    return fc.recursive_forecast(fits, weekly, keys=["state"])


@query("i16_next_week_forecast", "date:d predicted_items_next_week:f", _ahead_sql("week_targets", "week_model", [], 1))
def i16(spark, d):
    fits, weekly = weekly_ridge(spark, d)
    return fc.next_week_forecast(fits, weekly)


@query(
    "i16_next_week_features",
    "date:d " + " ".join(f"{c}:f" for c in se.WEEKLY_FEATURES),
    """
WITH w AS (SELECT date, CAST(items AS DOUBLE) AS y, row_number() OVER (ORDER BY date DESC) AS p FROM week_series)
SELECT max(date) + 7 AS date, max(y) FILTER (p = 1) AS lag_1, max(y) FILTER (p = 4) AS lag_4, max(y) FILTER (p = 12) AS lag_12,
  avg(y) FILTER (p <= 4) AS rolling_mean_4, avg(y) FILTER (p <= 12) AS rolling_mean_12, month(max(date) + 7) AS month,
  quarter(max(date) + 7) AS quarter, count(*) AS time_idx FROM w
""",
)
def i16_features(spark, d):
    return fc.next_week_features(week_series(spark, d))
