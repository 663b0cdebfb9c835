from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import forecast as fc
from basketry.operators import ridge as rg
from basketry.operators import series as se

SUNDAY = date(2023, 1, 1)


def weekly(rows, n=40, state="s"):
    return rows("state string, date date, items long", *[(state, SUNDAY + timedelta(days=7 * i), int(50 + 10 * np.sin(i) + i)) for i in range(n)])


def test_lags_and_windows_need_full_history(rows):
    table = {r["date"]: r for r in se.weekly_model_table(weekly(rows, 16)).collect()}
    values = [int(50 + 10 * np.sin(i) + i) for i in range(16)]
    assert len(table) == 4
    row = table[SUNDAY + timedelta(days=7 * 13)]
    assert (row["lag_1"], row["lag_4"], row["lag_12"], row["time_idx"]) == (values[12], values[9], values[1], 13)
    assert row["rolling_mean_4"] == pytest.approx(np.mean(values[9:13])) and row["rolling_mean_12"] == pytest.approx(np.mean(values[1:13]))


def test_series_do_not_mix(rows):
    both = weekly(rows, 14, "a").unionByName(weekly(rows, 13, "b"))
    table = se.weekly_model_table(both, keys=["state"])
    assert {r["state"]: r["count"] for r in table.groupBy("state").count().collect()} == {"a": 2, "b": 1}


def test_expanding_folds(rows):
    folded = se.expanding_folds(weekly(rows, 20)).orderBy("date").collect()
    # 20 // 6 = 3 rows a fold, the first test row is 20 - 15 = 5
    assert [r["fold"] for r in folded] == [0] * 5 + [1] * 3 + [2] * 3 + [3] * 3 + [4] * 3 + [5] * 3


@pytest.mark.parametrize("values, expected", [([10.0], [10.0] * 3), ([4.0, 6.0], [7.0, 9.0, 11.0]), ([50, 40, 30, 20, 10, 0], [0.0, 0.0, 0.0]), ([9, 1, 2, 3, 4, 5, 6], [6.0, 7.0, 8.0])])
def test_outlook(rows, values, expected):
    months = rows("month date, revenue double", *[(date(2024, 1 + i, 1), float(v)) for i, v in enumerate(values)])
    got = se.sales_outlook(months).orderBy("month").collect()
    assert [r["forecast_revenue"] for r in got] == pytest.approx(expected)
    assert got[0]["month"] == f"2024-{1 + len(values):02d}"


def test_date_split_and_errors(rows):
    df = rows("order_date date", *[(date(2024, 1, 1) + timedelta(days=i),) for i in range(20)])
    assert se.date_split(df).where("is_train").count() == 17
    pairs = rows("a double, p double", (10.0, 8.0), (20.0, 24.0))
    r = se.error_measures(pairs, "a", "p").first()
    assert (r["mae"], r["wape"]) == (3.0, pytest.approx(6 / 30)) and r["rmse"] == pytest.approx(10**0.5)


def closed_form_ridge(x, y, alpha=1.0):
    xm, ym = x.mean(axis=0), y.mean()
    w = np.linalg.solve((x - xm).T @ (x - xm) + alpha * np.eye(x.shape[1]), (x - xm).T @ (y - ym))
    return w, ym - xm @ w


def test_ridge_matches_the_closed_form(rows):
    table = se.weekly_model_table(weekly(rows, 60))
    model = fc.fit_ridge(table, se.WEEKLY_FEATURES)
    data = table.toPandas()
    w, b = closed_form_ridge(data[se.WEEKLY_FEATURES].to_numpy(float), data["target"].to_numpy(float))
    assert np.allclose(model.coefficients.toArray(), w, atol=1e-4) and model.intercept == pytest.approx(b, abs=1e-2)


def test_recursive_forecast_equals_a_loop(rows):
    history = weekly(rows, 40)
    table = se.weekly_model_table(history)
    fits = rg.ridge_by_series(table, [], se.WEEKLY_FEATURES, scaled=False)
    data = table.toPandas()
    w, b = closed_form_ridge(data[se.WEEKLY_FEATURES].to_numpy(float), data["target"].to_numpy(float))
    values = [float(int(50 + 10 * np.sin(i) + i)) for i in range(40)]
    last = SUNDAY + timedelta(days=7 * 39)
    expected = []
    for step in range(8):
        d = last + timedelta(days=7 * (step + 1))
        x = [values[-1], values[-4], values[-12], np.mean(values[-4:]), np.mean(values[-12:]), d.month, (d.month + 2) // 3, len(values)]
        values.append(float(w @ np.array(x) + b))
        expected.append(values[-1])
    got = fc.recursive_forecast(fits, history).orderBy("date").collect()
    assert [r["forecast_items"] for r in got] == pytest.approx(expected)
    assert got[0]["date"] == last + timedelta(days=7)
    assert fc.next_week_forecast(fits, history).first()["predicted_items_next_week"] == pytest.approx(expected[0])


def test_short_history_is_an_error(rows):
    with pytest.raises(Exception, match="at least 12 weeks"):
        fc.next_week_features(weekly(rows, 11)).collect()


def test_out_of_fold_columns(rows):
    rng = np.random.default_rng(3)
    noisy = rows("date date, items long", *[(SUNDAY + timedelta(days=7 * i), int(rng.integers(20, 90))) for i in range(120)])
    out = fc.out_of_fold(se.weekly_model_table(noisy), se.WEEKLY_FEATURES, ["linear", "scaled_linear", "ridge"])
    assert out.count() == 5 * (108 // 6)
    gap = out.select(F.max(F.abs(F.col("linear_pred") - F.col("scaled_linear_pred")))).first()[0]
    assert gap < 1e-4  # scaling does not move least squares


def scaled_ridge(x, y, alpha=1.0):
    m, d = x.mean(axis=0), x.std(axis=0)
    d = np.where(d > 0, d, 1.0)
    z = (x - m) / d
    return m, d, np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())), y.mean()


def test_every_series_has_its_own_ridge(rows):
    rng = np.random.default_rng(8)
    data = []
    for k, name in enumerate(["a", "b", None, "one"]):
        for _ in range(1 if name == "one" else 30):
            x = rng.normal(size=3) * [1, 100, 0.01] + [5, 1e4, 0]
            data.append((name, float(x[0]), float(x[1]), float(x[2]), 7.0, float(k * x[0] - x[1] / 50 + rng.normal())))
    data += [("a", None, 1.0, 1.0, 7.0, 3.0), ("a", 1.0, 1.0, 1.0, 7.0, None), ("nothing", None, 1.0, 1.0, 7.0, 1.0)]
    features = ["p", "q", "r", "same"]
    fits = rg.ridge_by_series(rows("state string, p double, q double, r double, same double, target double", *data), ["state"], features)
    got = {f.state: f for f in fits.collect()}
    assert set(got) == {"a", "b", None, "one"}
    for name, f in got.items():
        table = np.array([d[1:] for d in data if d[0] == name and None not in d[1:]], float)
        m, d, w, b = scaled_ridge(table[:, :4], table[:, 4])
        assert f.rows == len(table) and np.allclose(f.weights, w, atol=1e-8) and np.allclose(f.middle, m) and f.intercept == pytest.approx(b)
        assert f.weights[3] == 0.0 and f.scale[3] == 1.0


def test_folds_see_earlier_folds_only(rows):
    rng = np.random.default_rng(9)
    data = [(s, SUNDAY + timedelta(days=7 * i), i // 6, float(rng.normal()), float(rng.normal())) for s in "ab" for i in range(24)]
    data += [("late", SUNDAY, 2, 1.0, 1.0)]
    table = rows("state string, date date, fold int, p double, target double", *data)
    got = {(r.state, r.date): r.ridge_pred for r in rg.ridge_out_of_fold(table, ["state"], ["p"], folds=3).collect()}
    assert len(got) == 2 * 18 + 1 and got["late", SUNDAY] is None
    for s, day, fold, p, _ in data:
        if fold > 0 and s != "late":
            train = np.array([r[3:] for r in data if r[0] == s and r[2] < fold])
            m, d, w, b = scaled_ridge(train[:, :1], train[:, 1])
            assert got[s, day] == pytest.approx(b + w[0] * (p - m[0]) / d[0])


def test_no_rows_no_fit(rows):
    empty = rows("p double, target double", (1.0, 2.0)).limit(0)
    assert rg.ridge_by_series(empty, [], ["p"]).count() == 0
