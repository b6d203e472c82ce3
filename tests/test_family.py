"""A family of one's own: trained, saved, loaded and forecast through the registry."""

import datetime as dt
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from acequia.models import arma, linear
from acequia.models.batches import gathered, isolated
from acequia.models.family import Family, by_forecast, family, known, register, series_family, unregister
from acequia.plans.predict import history_pack, predict_all
from acequia.plans.train import train_all
from acequia.schema import DAY, KEY, TrainConfig
from acequia.sources.registry import load_models, save_models

NAMES = ("temp_c", "rh")


def climate(spark, stations=3, n=60):
    rng = np.random.default_rng(9)
    rows = [
        (s, dt.date(2020, 1, 1) + dt.timedelta(i), float(10 + s + i * 0.1 + rng.normal()), float(50 + rng.normal()))
        for s in range(stations)
        for i in range(n if s != 2 else 6)
    ]
    return spark.createDataFrame(rows, f"{KEY} long, {DAY} date, temp_c double, rh double")


class Holt:
    """Level and trend, smoothed; lives in the test, not in the library."""

    @staticmethod
    def fit(series, parameters):
        if len(series) < 10:
            raise RuntimeError("not enough for a trend")
        alpha = float(parameters["alpha"])
        level, trend = series[0], 0.0
        for x in series[1:]:
            before, level = level, alpha * x + (1 - alpha) * (level + trend)
            trend = alpha * (level - before) + (1 - alpha) * trend
        return np.array([trend])

    @staticmethod
    def forecast(coef, state, horizon, parameters):
        assert len(state) <= 3
        return state.mean() + coef[0] * np.arange(1, horizon + 1) * float(parameters["damping"])


@pytest.fixture
def holt():
    made = series_family(
        "holt", Holt.fit, Holt.forecast, state_days=3, parameters={"alpha": 0.3, "damping": 1}
    )
    yield register(made)
    unregister("holt")


def test_own_family_end_to_end(spark, holt, tmp_path):
    df = climate(spark)
    seen = Observation()
    config = TrainConfig(
        families=("holt", "var"), variables=NAMES, maxlags=2, test_size=0, parameters={"holt": {"alpha": 0.5}}
    )
    save_models(train_all(df, config, seen), str(tmp_path / "models"))
    assert seen.get == {"models": 9, "failures": 3}  # station 2 is too short for either
    saved = load_models(spark, str(tmp_path / "models"), ["holt", "var"])
    ours = saved.filter("model_type = 'holt'").collect()
    assert {r["params"]["alpha"] for r in ours} == {"0.5"}
    assert {r["params"]["damping"] for r in ours} == {"1"}
    errors = {(r[KEY], r["target"]): r["error"] for r in ours}
    assert errors[0, "rh"] is None and "not enough for a trend" in errors[2, "rh"]

    seen = Observation()
    out = predict_all(saved, history_pack(df, NAMES), 5, observed=seen).collect()
    assert seen.get == {"rows": len(out), "failures": sum(r["error"] is not None for r in out)}
    values = {(r[KEY], r["variable"], r["step"]): r["value"] for r in out if r["model"] == "holt"}
    history = {(r[KEY]): r for r in history_pack(df, NAMES).collect()}
    for model in ours:
        if model["error"] is None:
            scale = model["scales"][model["target"]]
            series = (np.array(history[model[KEY]][model["target"]]) - scale["center"]) / scale["scale"]
            trend = Holt.fit(series, {"alpha": 0.5})
            want = Holt.forecast(trend, series[-3:], 5, {"damping": "1"}) * scale["scale"] + scale["center"]
            got = [values[model[KEY], model["target"], h] for h in range(1, 6)]
            np.testing.assert_allclose(got, want, rtol=1e-9)
    lost = [r for r in out if r["error"] is not None and r["model"] == "holt"]
    assert {(r[KEY], r["variable"]) for r in lost} == {(2, "temp_c"), (2, "rh")}
    assert all(r["error"].startswith("not trained: ") and r[DAY] is None for r in lost)


def test_unknown_types_stay_error_rows(spark, holt):
    df = climate(spark, stations=1)
    models = train_all(df, TrainConfig(families=("holt",), variables=NAMES, test_size=0))
    odd = models.withColumn("model_type", F.lit("oracle"))
    out = predict_all(models.unionByName(odd), history_pack(df, NAMES), 3).collect()
    lost = [r for r in out if r["error"]]
    assert {r["error"] for r in lost} == {"unknown model type oracle"} and len(lost) == 2
    assert sum(r["error"] is None for r in out) == 6


def test_forecast_that_fails_costs_itself(spark):
    def fit(series, parameters):
        return series[:1]

    def forecast(coef, state, horizon, parameters):
        if state[0] > 0:
            raise ValueError("positive start")
        return np.full(horizon, coef[0])

    register(series_family("picky", fit, forecast))
    try:
        df = climate(spark, stations=2)
        models = train_all(df, TrainConfig(families=("picky",), variables=NAMES, test_size=0))
        out = predict_all(models, history_pack(df, NAMES), 2).collect()
        by_model = {}
        for r in out:
            by_model.setdefault((r[KEY], r["variable"]), []).append(r)
        assert len(by_model) == 4
        for rows in by_model.values():
            assert len(rows) == 2 or rows[0]["error"] == "ValueError: positive start"
    finally:
        unregister("picky")


def test_registry_of_families(holt):
    assert {"sarima", "sarimax", "var", "window", "holt"} <= set(known())
    with pytest.raises(ValueError, match="registered already"):
        register(Family("var", None, None))
    with pytest.raises(ValueError, match="unknown model family"):
        family("nope")
    with pytest.raises(ValueError, match="families must be drawn from"):
        TrainConfig(families=("nope",))
    jobs = by_forecast(["sarima", "sarimax", "var", "holt", "nope", None])
    assert sorted(names for _, names in jobs) == [["holt"], ["sarima", "sarimax"], ["var"]]


@pytest.mark.parametrize("few", (0, 32))
def test_derivatives_like_differences(few, monkeypatch):
    monkeypatch.setattr(arma, "FEW_SERIES", few)
    rng = np.random.default_rng(1)
    shape = arma.Shape(2, 1, 1, 2, 5, const=True, r=2)
    lengths = np.array([120, 119, 90, 60])
    w, x = rng.normal(size=(120, 4)), rng.normal(size=(2, 120, 4))
    for i, n in enumerate(lengths):
        w[: 120 - n, i], x[:, : 120 - n, i] = 0, 0
    params, start = rng.uniform(-0.4, 0.4, size=(shape.size, 4)), 120 - lengths
    exact = arma.derivatives(shape, params, w, x, start, arma.residuals(shape, params, w, x, start))
    for i in range(shape.size):
        up, down = params.copy(), params.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (arma.residuals(shape, up, w, x, start) - arma.residuals(shape, down, w, x, start)) / 2e-6
        np.testing.assert_allclose(exact[:, i], slope, atol=1e-7)


@pytest.mark.parametrize("orders", ((1, 1), (1, 0), (2, 1), (0, 2), (2, 2)))
def test_moving_averages_by_definition(orders):
    """Blocks of rows and seasons give what the recursion gives row by row."""
    (q, Q), s, rng = orders, 7, np.random.default_rng(4)
    shape, first = arma.Shape(0, q, 0, Q, s, const=False), 5
    params, u = rng.uniform(-0.5, 0.5, size=(shape.size, 3)), rng.normal(size=(200, 3))
    u[:first] = 0
    _, theta, _, stheta = shape.split(params)
    want = u.copy()
    for t in range(first, len(u)):
        for lag, weight in arma.lag_weights(theta, stheta, s, 1.0).items():
            if t >= lag:
                want[t] -= weight * want[t - lag]
    np.testing.assert_allclose(arma._without_moving(u.copy(), theta, stheta, s, first), want, atol=1e-12)


def test_products_by_definition():
    rng = np.random.default_rng(6)
    jac, errors = rng.normal(size=(131, 4, 3)), rng.normal(size=(131, 3))
    normal, grad = arma._products(jac, errors)
    np.testing.assert_allclose(normal, np.einsum("tin,tjn->nij", jac, jac), atol=1e-12)
    np.testing.assert_allclose(grad[..., 0], np.einsum("tin,tn->ni", jac, errors), atol=1e-12)


def simulate(n, count, seed=0, phi=0.3, theta=-0.6, sphi=0.2, stheta=-0.7, s=12):
    rng = np.random.default_rng(seed)
    e, w = rng.normal(size=(n + 200, count)), np.zeros((n + 200, count))
    for t in range(s + 1, n + 200):
        w[t] = phi * w[t - 1] + sphi * w[t - s] - phi * sphi * w[t - s - 1]
        w[t] += e[t] + theta * e[t - 1] + stheta * e[t - s] + theta * stheta * e[t - s - 1]
    return w[200:]


def test_start_values_are_near_and_save_rounds():
    w, shape = simulate(2400, 12), arma.Shape(1, 1, 1, 1, 12)
    lengths = np.full(12, 2400)
    starts = arma.start_values(shape, w, None, lengths)
    near = arma.fit(shape, w, None, lengths, starts)
    plain = arma.fit(shape, w, None, lengths)
    assert near[4].mean() <= plain[4].mean()
    np.testing.assert_allclose(near[1], plain[1], rtol=1e-3)
    first = arma._sse(arma.residuals(shape, starts, w, None, np.zeros(12, int))) / near[2]
    assert (first < 1.1 * near[1]).all()


def test_start_values_by_two_regressions():
    """One series, both regressions by least squares on explicit designs."""
    w, shape = simulate(900, 1, seed=3), arma.Shape(1, 1, 1, 1, 12)
    y, lags = w[:, 0], arma.long_lags(shape)
    first = lags[-1]
    z = np.column_stack([np.ones(900 - first), *[y[first - i : 900 - i] for i in lags]])
    e = np.zeros(900)
    e[first:] = y[first:] - z @ np.linalg.lstsq(z, y[first:], rcond=None)[0]
    at, back = first + 13, (1, 12, 13)
    z = np.column_stack(
        [np.ones(900 - at), *[y[at - i : 900 - i] for i in back], *[e[at - i : 900 - i] for i in back]]
    )
    c, p1, p12, _, t1, t12, _ = np.linalg.lstsq(z, y[at:], rcond=None)[0]
    got = arma.start_values(shape, w, None, np.array([900]))[:, 0]
    np.testing.assert_allclose(got, [c, p1, t1, p12, t12], rtol=1e-6)
    mixed = np.c_[w, np.r_[np.zeros(300), w[300:, 0]]]
    both = arma.start_values(shape, mixed, None, np.array([900, 600]))
    alone = arma.start_values(shape, w[300:], None, np.array([600]))
    np.testing.assert_allclose(both[:, 0], got, rtol=1e-9)
    np.testing.assert_allclose(both[:, 1], alone[:, 0], rtol=1e-9)
    short = arma.start_values(shape, w[:45], None, np.array([45]))
    assert np.isnan(short).all()
    assert np.isfinite(arma.fit(shape, w[:45], None, np.array([45]), short)[1]).all()


@pytest.mark.parametrize("n,k,lags", [(400, 3, 7), (90, 2, 30), (64, 1, 31), (9, 2, 3), (5, 1, 0)])
def test_cross_products_like_the_design(n, k, lags):
    block = np.random.default_rng(n).normal(size=(n, k)) + 2
    z = linear.lagged_terms(block, lags)
    np.testing.assert_allclose(linear.cross_products(block, lags), z.T @ z, rtol=1e-9)


def test_nested_errors_like_single_regressions():
    block = np.random.default_rng(4).normal(size=(300, 3)).cumsum(axis=0) * 0.1
    gram = linear.cross_products(block, 6)
    nested = linear.nested_errors(gram, 3, 6)
    for p in range(7):
        np.testing.assert_allclose(nested[p], linear.regress(gram, 3, p)[1], rtol=1e-6, atol=1e-9)
    collinear = np.c_[block, block[:, 0] * 2]
    assert linear.nested_errors(linear.cross_products(collinear, 6), 4, 6) is None
    assert np.isfinite(linear.criteria(gram, 294, 3, 6)).all()


def threshold_series(n, seed):
    """Rises below one half and falls above it: today says next to nothing linear about tomorrow."""
    rng, x = np.random.default_rng(seed), np.full(n, 0.3)
    for t in range(1, n):
        x[t] = np.clip(1.8 * min(x[t - 1], 1 - x[t - 1]) + 0.02 * rng.normal(), 0.01, 0.99)
    return x


def test_features_follow_a_threshold(spark):
    n, keep, days = 1500, 1300, 4
    series = {s: threshold_series(n, s) for s in range(2)}
    start = dt.date(2020, 1, 1)
    rows = [(s, start + dt.timedelta(i), float(x)) for s, xs in series.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, f"{KEY} long, {DAY} date, temp_c double")
    settings = {"families": ("window",), "variables": ("temp_c",), "window": days, "ridge": 0.01, "test_size": n - keep}
    error = {}
    for own in ({}, {"features": 100, "width": 0.6}):
        models = train_all(df, TrainConfig(**settings, parameters={"window": own}))
        waves = linear.Waves(100, 0.6, 1) if own else None
        past = df.filter(F.date_diff(DAY, F.lit(start)) < keep)
        ahead = {r[KEY]: r["value"] for r in predict_all(models, history_pack(past, ("temp_c",)), 1).collect()}
        squares = []
        for r in models.collect():
            scale, xs = r["scales"]["temp_c"], series[r[KEY]]
            z = (xs - scale["center"]) / scale["scale"]
            coef = np.array(r["coef"]).reshape(1, -1, 1)
            states = np.stack([z[t - days : t] for t in range(keep, n)])[:, :, None]
            path = linear.recurse(np.repeat(coef, len(states), 0), states, 1, waves)[:, 0, 0]
            got = path * scale["scale"] + scale["center"]
            assert abs(ahead[r[KEY]] - got[0]) < 1e-9  # the saved model forecasts as it was fitted
            squares.append(np.mean((got - xs[keep:]) ** 2))  # days the fit has not seen
        error[bool(own)] = np.sqrt(np.mean(squares))
    assert error[True] < 0.04 < 0.1 < error[False]


def test_recursion_with_features_is_the_regression_fed_back():
    rng = np.random.default_rng(2)
    waves = linear.Waves(20, 1.5, 7)
    block = rng.normal(size=(200, 2))
    gram = linear.wave_products(block, 3, waves, days=64)
    coef, errors = linear.regress(gram, 2, 3, 0.1, 20)
    z = linear.lagged_terms(block, 3)
    z = np.hstack([z[:, :1], z[:, 3:], waves.of(z[:, 3:])])
    penalty = np.diag([0.0] + [0.1] * (z.shape[1] - 1))
    want = np.linalg.solve(z.T @ z + penalty, z.T @ block[3:])
    np.testing.assert_allclose(coef, want, rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(errors, (block[3:] - z @ want).T @ (block[3:] - z @ want), rtol=1e-6)
    path = linear.recurse(coef[None], block[None, -3:], 4, waves)[0]
    state = block[-3:]
    for h in range(4):
        window = state[::-1].ravel()
        now = np.r_[1.0, window, waves.of(window)] @ coef
        np.testing.assert_allclose(path[h], now, rtol=1e-9)
        state = np.vstack([state[1:], now])


@pytest.mark.parametrize("r", (0, 2))
def test_slow_series_go_on_together(r, monkeypatch):
    """Groups whose few slow series are pooled give each series what it gets alone."""
    rng = np.random.default_rng(8)
    w, shape = simulate(400, 10, seed=8), arma.Shape(1, 1, 1, 1, 12, const=not r, r=r)
    lengths, x = np.array([400, 390] * 5), rng.normal(size=(r, 400, 10)) if r else None
    for i, n in enumerate(lengths):
        w[: 400 - n, i] = 0
        if r:
            x[:, : 400 - n, i] = 0
    whole = arma.fit(shape, w, x, lengths)
    monkeypatch.setattr(arma, "GROUP_SERIES", 4)
    pooled = arma.fit(shape, w, x, lengths)
    for a, b in zip(whole, pooled):
        np.testing.assert_allclose(a, b, rtol=1e-8)
    for i, n in enumerate(lengths):
        alone = arma.fit(shape, w[400 - n :, [i]], x[:, 400 - n :, [i]] if r else None, lengths[[i]])
        np.testing.assert_allclose(pooled[0][:, i], alone[0][:, 0], rtol=1e-8)
        assert pooled[4][i] == alone[4][0] and pooled[3][i] == alone[3][0]
    cut = arma.fit(shape, w, x, lengths, rounds=3)
    assert (cut[4] <= 3).all() and (cut[3] == (whole[4] <= 3)).all()


def test_derivatives_are_kept_for_a_chunk_of_days_alone():
    """A fit's memory holds no derivatives of all days, whatever the number of series."""
    w, shape = simulate(1500, 200, seed=9), arma.Shape(1, 1, 1, 1, 12)
    lengths = np.full(200, 1500)
    tracemalloc.start()
    try:
        arma.fit(shape, w, None, lengths, rounds=2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < (shape.size + 3) * w.nbytes


def test_batches_are_gathered_across_frames():
    frames = [pd.DataFrame({"a": range(at, at + n)}) for at, n in ((0, 3), (3, 0), (3, 9), (12, 1))]
    got = [list(pdf["a"]) for pdf in gathered(iter(frames), 5)]
    assert got == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [10, 11, 12]]
    assert list(gathered(iter([]), 5)) == []


def test_a_bad_series_costs_few_runs_of_its_batch():
    runs = []

    def work(pdf):
        runs.append(len(pdf))
        if (pdf["a"] == 13).any():
            raise ValueError("bad")
        return pdf

    out = pd.concat(isolated(pd.DataFrame({"a": range(64)}), work, lambda pdf, message: pdf.assign(a=-1)))
    assert list(out["a"]) == [-1 if i == 13 else i for i in range(64)] and len(runs) == 13
