"""Models on simulated series, against NumPy and against their own definition."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from acequia.models import ar, arma, linear, sarima, var
from acequia.operators.scaling import scales_map
from acequia.operators.series import pack_series
from acequia.plans.predict import forecast_irrigation, history_pack, predict_all, publish
from acequia.plans.train import fit_family, train_all, training_pack
from acequia.schema import VARIABLES, TrainConfig

START = dt.date(2015, 1, 1)


def table(spark, blocks, names):
    """Daily rows from {station: (days, variables) array}."""
    rows = [
        (k, START + dt.timedelta(days=i), *map(float, row))
        for k, block in blocks.items()
        for i, row in enumerate(block)
    ]
    columns = ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(rows, f"station bigint, day date, {columns}")


def simulate(phi, theta, sphi, stheta, n, s, count, seed=0):
    rng = np.random.default_rng(seed)
    total = n + 10 * s
    e, w = rng.standard_normal((total, count)), np.zeros((total, count))
    auto = {1: phi, s: sphi, s + 1: -phi * sphi}
    moving = {1: theta, s: stheta, s + 1: theta * stheta}
    for t in range(s + 1, total):
        w[t] = e[t]
        for lag, a in auto.items():
            w[t] += a * w[t - lag]
        for lag, m in moving.items():
            w[t] += m * e[t - lag]
    return w[-n:]


@pytest.mark.parametrize(
    "truth", [(0.6, 0.3, 0.5, -0.3), (0.3, -0.9, 0.1, -0.9), (0.5, 0.0, 0.6, 0.0)]
)
def test_error_variance_is_recovered(truth):
    w = simulate(*truth, n=2400, s=12, count=8)
    shape = arma.Shape(1, 1, 1, 1, 12)
    _, sigma2, used, converged, _ = arma.fit(shape, w, None, np.full(8, 2400))
    assert abs(np.sqrt(sigma2).mean() - 1.0) < 0.03
    assert (used == 2400 - 13).all() and converged.all()


def test_pure_ar_coefficients():
    w = simulate(0.5, 0.0, 0.6, 0.0, n=3000, s=12, count=4)
    params, *_ = arma.fit(arma.Shape(1, 0, 1, 0, 12), w, None, np.full(4, 3000))
    assert np.abs(params[1] - 0.5).max() < 0.1 and np.abs(params[2] - 0.6).max() < 0.1


@pytest.mark.parametrize("phi", [0.98, 0.995, 0.9995])
def test_near_unit_root_equals_least_squares(phi):
    """No coefficient is clipped: a first-order fit is the regression on the day before."""
    rng = np.random.default_rng(int(phi * 1e4))
    w = np.zeros((2000, 3))
    for t in range(1, 2000):
        w[t] = 0.1 + phi * w[t - 1] + rng.standard_normal(3)
    params, _, _, converged, _ = arma.fit(arma.Shape(1, 0, 0, 0, 1), w, None, np.full(3, 2000))
    for i in range(3):
        slope, const = np.polyfit(w[:-1, i], w[1:, i], 1)
        np.testing.assert_allclose(params[:, i], [const, slope], rtol=1e-6)
    assert converged.all()


def test_a_fit_that_still_falls_is_told():
    w = simulate(0.5, 0.4, 0.3, -0.5, n=600, s=7, count=3)
    *_, converged, _ = arma.fit(arma.Shape(1, 1, 1, 1, 7), w, None, np.full(3, 600), rounds=0)
    assert not converged.any()


def test_lengths_are_independent():
    """A short series in a batch of longer ones is fitted as if alone."""
    w = simulate(0.5, 0.2, 0.3, -0.2, n=600, s=7, count=2)
    shape = arma.Shape(1, 1, 1, 1, 7)
    short = w[300:, :1]
    mixed = w.copy()
    mixed[:300, 0] = 0.0
    alone = arma.fit(shape, short, None, np.array([300]))
    both = arma.fit(shape, mixed, None, np.array([300, 600]))
    np.testing.assert_allclose(both[1][0], alone[1][0], rtol=1e-6)
    np.testing.assert_allclose(both[0][:, 0], alone[0][:, 0], atol=1e-4)
    a = arma.forecast(shape, alone[0], short, None, np.array([300]), 10)
    b = arma.forecast(shape, np.c_[alone[0], both[0][:, 1]], mixed, None, np.array([300, 600]), 10)
    np.testing.assert_allclose(a[:, 0], b[:, 0], atol=1e-9)


def test_residuals_and_forecast_by_definition():
    shape, rng = arma.Shape(2, 1, 1, 1, 4, const=True), np.random.default_rng(5)
    w, params = rng.normal(size=(60, 1)), np.array([[0.1], [0.3], [-0.2], [0.4], [0.25], [-0.3]])
    c, p1, p2, th, sp, st = params[:, 0]
    x, e = w[:, 0], np.zeros(70)
    auto = {1: p1, 2: p2, 4: sp, 5: -p1 * sp, 6: -p2 * sp}
    moving = {1: th, 4: st, 5: th * st}

    def mean(t, series):
        back = sum(a * series[t - k] for k, a in auto.items())
        return c + back + sum(m * e[t - k] for k, m in moving.items() if t >= k)

    for t in range(6, 60):
        e[t] = x[t] - mean(t, x)
    got = arma.residuals(shape, params, w, None, np.array([0]))
    np.testing.assert_allclose(got[:, 0], e[:60], atol=1e-12)
    path = list(x)
    for t in range(60, 70):
        path.append(mean(t, path))
    ahead = arma.forecast(shape, params, w, None, np.array([60]), 10)
    np.testing.assert_allclose(ahead[:, 0], path[60:], atol=1e-12)


NAMES = ("temp_c", "rh", "wind_ms")


def seasonal_climate(n=500, seed=1):
    rng = np.random.default_rng(seed)
    day = np.arange(n)[:, None]
    base = np.cumsum(rng.normal(size=(n, 3)) * 0.1, axis=0)
    wave = np.sin(2 * np.pi * (day % 7) / 7 + np.arange(3))
    out = 10 + base + wave + rng.normal(size=(n, 3)) * 0.3
    out[:, 0] += 0.8 * out[:, 1]
    return out


SMALL = TrainConfig(
    families=("sarima", "sarimax", "var", "window"),
    order=(1, 1, 1),
    seasonal=(1, 1, 1, 7),
    maxlags=6,
    test_size=0,
    window=10,
    variables=NAMES,
)


def test_sarimax_finds_the_regressor(spark):
    block = seasonal_climate()
    pack = training_pack(table(spark, {1: block}, NAMES), SMALL)
    row = sarima.fit(pack, SMALL, "sarimax").filter("target = 'temp_c'").first()
    beta_rh = row["coef"][0] * block[:, 0].std() / block[:, 1].std()
    assert beta_rh == pytest.approx(0.8, abs=0.1)
    plain = sarima.fit(pack, SMALL, "sarima").filter("target = 'temp_c'").first()
    assert row["sigma2"] < plain["sigma2"]
    assert row["params"]["converged"] in ("true", "false")
    assert row["name"] == "sarimax_temp_c" and len(row["coef"]) == 2 + 4
    assert len(plain["coef"]) == 1 + 4


@pytest.mark.parametrize("family, policy", [("sarima", "hold"), ("sarimax", "hold"), ("sarimax", "head")])
def test_forecast_levels(spark, family, policy):
    """The Spark forecast equals the model equation run on unscaled levels."""
    block, h = seasonal_climate(), 15
    df = table(spark, {1: block}, NAMES)
    model = sarima.fit(training_pack(df, SMALL), SMALL, family).filter("target = 'wind_ms'")
    row = model.first()
    got = sarima.forecast(model, history_pack(df, NAMES), h, policy)
    got = [r["value"] for r in got.orderBy("step").collect()]
    center, scale = block.mean(0), block.std(0)
    center[2], scale[2] = np.median(block[:, 2]), np.subtract(*np.quantile(block[:, 2], [0.75, 0.25]))
    z = (block - center) / scale
    params = np.array(row["coef"])
    beta = np.zeros(2) if family == "sarima" else params[:2]
    rest = params[1:] if family == "sarima" else params[2:]
    const = params[0] if family == "sarima" else 0.0
    u = z[:, 2] - z[:, :2] @ beta
    w = np.diff(u[7:] - u[:-7])
    p, t, sp, st = rest
    e = np.zeros(len(w) + h)
    path = list(w)
    for i in range(8, len(w) + h):
        mean = const + p * path[i - 1] + sp * path[i - 7] - p * sp * path[i - 8]
        mean += t * e[i - 1] + st * e[i - 7] + t * st * e[i - 8]
        if i < len(w):
            e[i] = w[i] - mean
        else:
            path.append(mean)
    levels = list(u)
    for step in path[len(w):]:
        levels.append(levels[-1] + levels[-7] - levels[-8] + step)
    future = z[:h, :2] if policy == "head" else np.tile(z[-1, :2], (h, 1))
    want = (np.array(levels[-h:]) + future @ beta) * scale[2] + center[2]
    np.testing.assert_allclose(got, want, rtol=1e-8)


def lag_design(z, p, first):
    """Rows first.. of z on a constant and p lags, built row by row."""
    rows = [np.concatenate([[1.0], *[z[t - i] for i in range(1, p + 1)]]) for t in range(first, len(z))]
    return np.array(rows), z[first:]


@pytest.mark.parametrize("block_days", [50, 1024])
def test_var_like_numpy(spark, monkeypatch, block_days):
    monkeypatch.setattr(var, "BLOCK_DAYS", block_days)
    blocks = {k: seasonal_climate(seed=k) for k in (1, 2)}
    pack = training_pack(table(spark, blocks, NAMES), SMALL)
    solution = var.solve(pack, NAMES, 6, "aic")
    plan = solution._jdf.queryExecution().executedPlan().toString()
    # all exchanges lie below the one task that adds up, chooses and solves
    assert plan.count("MapInPandas") == 1 and plan.index("Exchange") > plan.index("MapInPandas")
    solved = {r["station"]: r for r in solution.collect()}
    scales = {r["station"]: r["scales"] for r in pack.collect()}
    for k, block in blocks.items():
        z = np.column_stack(
            [(block[:, j] - scales[k][c]["center"]) / scales[k][c]["scale"] for j, c in enumerate(NAMES)]
        )
        scores = []
        for p in range(7):
            x, y = lag_design(z, p, 6)
            resid = y - x @ np.linalg.lstsq(x, y, rcond=None)[0]
            sigma = resid.T @ resid / len(y)
            scores.append(np.linalg.slogdet(sigma)[1] + 2 / len(y) * (9 * p + 3))
        got = solved[k]
        np.testing.assert_allclose(np.array(got["criteria"]).reshape(7, 4)[:, 0], scores, rtol=1e-8)
        best = int(np.argmin(scores))
        assert got["p"] == best and got["n"] == 500 - best
        x, y = lag_design(z, best, best)
        want = np.linalg.lstsq(x, y, rcond=None)[0]
        np.testing.assert_allclose(np.reshape(got["coef"], want.shape), want, atol=1e-8)


def test_var_forecast_by_definition(spark):
    block, h = seasonal_climate(), 12
    df = table(spark, {1: block}, NAMES)
    for family, scales in (("var", "scales"), ("window", "ranges")):
        pack = training_pack(df, SMALL)
        models = var.fit(pack, SMALL, family)
        row, sc = models.first(), pack.first()[scales]
        p = int(row["params"]["p"])
        center = np.array([sc[c]["center"] for c in NAMES])
        width = np.array([sc[c]["scale"] for c in NAMES])
        coef, z = np.reshape(row["coef"], (1 + 3 * p, 3)), list((block - center) / width)
        for _ in range(h):
            z.append(np.concatenate([[1.0], *[z[-i] for i in range(1, p + 1)]]) @ coef)
        got = var.forecast(models, history_pack(df, NAMES), h)
        got = got.groupBy("step").pivot("target", list(NAMES)).agg(F.first("value")).orderBy("step")
        np.testing.assert_allclose(
            got.select(*NAMES).toPandas().to_numpy(), np.array(z[-h:]) * width + center, rtol=1e-9
        )


def test_window_ridge_like_numpy(spark):
    block = seasonal_climate()
    row = var.fit(training_pack(table(spark, {1: block}, NAMES), SMALL), SMALL, "window").first()
    z = (block - block.min(0)) / np.ptp(block, axis=0)
    x, y = lag_design(z, 10, 10)
    penalty = np.eye(31)
    penalty[0, 0] = 0.0
    want = np.linalg.solve(x.T @ x + penalty, x.T @ y)
    np.testing.assert_allclose(np.reshape(row["coef"], (31, 3)), want, atol=1e-9)


def test_collinear_normal_equations():
    xx = np.array([[2.0, 2.0], [2.0, 2.0]])
    got = linear.least_squares(xx, np.array([[2.0], [2.0]]))
    np.testing.assert_allclose(got, [[0.5], [0.5]])


def test_failures_are_rows(spark):
    """A short and a collinear station fail by themselves; the good one is trained."""
    good = seasonal_climate()
    twin = good.copy()
    twin[:, 1] = 2 * twin[:, 0]
    df = table(spark, {1: good, 2: good[:20], 3: twin}, NAMES)
    config = TrainConfig(
        families=("sarima", "var", "window"), seasonal=(1, 1, 1, 7), maxlags=6, window=10,
        test_size=20, variables=NAMES,
    )
    rows = train_all(df, config).collect()
    errors = {(r["model_type"], r["station"]): r["error"] for r in rows}
    assert errors["sarima", 1] is None and errors["var", 1] is None
    assert "too short" in errors["sarima", 2] and "too short" in errors["var", 2]
    assert "too short" in errors["window", 2]
    assert "collinear" in errors["var", 3] and errors["window", 3] is None
    assert len(rows) == 3 * 3 + 3 + 3
    out = predict_all(
        train_all(df, config), history_pack(df, NAMES), 5
    ).filter("error is null").groupBy("model", "station").count().collect()
    assert {(r["model"], r["station"]): r["count"] for r in out} == {
        ("sarima", 1): 15, ("sarima", 3): 15, ("var", 1): 15, ("window", 1): 15, ("window", 3): 15,
    }


def test_every_model_gives_rows_or_one_error_row(spark):
    """Failed fits, a station without history and an unknown type are told, not dropped."""
    good = seasonal_climate()
    df = table(spark, {1: good, 2: good[:12], 4: good}, NAMES)
    config = TrainConfig(families=("sarima", "var"), order=(0, 1, 0), seasonal=(0, 0, 0, 1),
                         maxlags=3, test_size=0, variables=NAMES)
    models = train_all(df, config).cache()
    other = models.filter("model_type = 'var' and station = 1").withColumn("model_type", F.lit("lstm"))
    history = history_pack(df.filter("station != 4"), NAMES)
    rows = predict_all(models.unionByName(other), history, 3).collect()
    told = {(r["model"], r["station"], r["variable"]): r["error"] for r in rows if r["error"]}
    assert {k[:2] for k in told} == {("var", 2), ("sarima", 4), ("var", 4), ("lstm", 1)}
    assert all("no history" in e for k, e in told.items() if k[1] == 4)
    assert "too short" in told["var", 2, "multivariate"] and "unknown model type" in told["lstm", 1, "multivariate"]
    assert len(told) == 1 + 3 + 1 + 1
    assert all(r["day"] is None and r["value"] is None for r in rows if r["error"])
    good_rows = [(r["model"], r["station"]) for r in rows if not r["error"]]
    assert sorted(set(good_rows)) == [("sarima", 1), ("sarima", 2), ("var", 1)]
    assert len(good_rows) == 3 * 3 * 3


def test_chosen_regressors(spark):
    config = TrainConfig(families=("sarimax",), seasonal=(1, 1, 1, 7), test_size=0, variables=NAMES,
                         regressors=("rh",))
    df = table(spark, {1: seasonal_climate()}, NAMES)
    models = train_all(df, config)
    sizes = {r["target"]: len(r["coef"]) for r in models.collect()}
    assert sizes == {"temp_c": 1 + 4, "rh": 4, "wind_ms": 1 + 4}
    assert predict_all(models, history_pack(df, NAMES), 4).filter("error is null").count() == 12
    with pytest.raises(ValueError, match="regressors"):
        TrainConfig(variables=("rh",), regressors=("temp_c",))


def test_stations_together_equal_alone(spark):
    blocks = {1: seasonal_climate(seed=4), 2: seasonal_climate(400, seed=5)}
    both = table(spark, blocks, NAMES)
    for family in SMALL.families:
        fits = []
        for df in (both, both.filter("station = 2")):
            rows = fit_family(training_pack(df, SMALL), SMALL, family).filter("station = 2").collect()
            fits.append({r["target"]: (r["sigma2"], r["coef"]) for r in rows})
        for target, (sigma2, coef) in fits[0].items():
            assert sigma2 == pytest.approx(fits[1][target][0], rel=1e-4), (family, target)


def test_constant_series(spark):
    block = np.full((300, 3), 5.0)
    df = table(spark, {1: block}, NAMES)
    rows = train_all(df, TrainConfig(families=("sarima", "window"), seasonal=(1, 1, 1, 7),
                                     window=10, test_size=0, variables=NAMES))
    out = predict_all(rows, history_pack(df, NAMES), 5).collect()
    assert len(out) == 2 * 3 * 5
    assert all(r["value"] == pytest.approx(5.0) for r in out)


def test_forecast_starts_after_history_in_natural_units(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 400
    block = np.column_stack([
        rng.normal(940, 10, n), rng.normal(30, 4, n), rng.uniform(0.5, 4, n), rng.normal(18, 4, n),
        rng.normal(2e7, 3e6, n), np.maximum(rng.normal(0, 3, n), 0), rng.normal(60, 8, n),
    ])
    df = table(spark, {7: block}, VARIABLES)
    config = TrainConfig(families=("sarima", "var"), seasonal=(1, 1, 1, 7), test_size=100)
    with pytest.raises(ValueError, match="horizon"):
        forecast_irrigation(train_all(df, config), history_pack(df), 500)
    models = train_all(df, config).filter("target != 'rh' or model_type = 'var'").cache()
    gaps = forecast_irrigation(models, history_pack(df), 5).filter("error is not null").collect()
    assert [(r["model"], r["station"], r["error"]) for r in gaps] == [("sarima", 7, "no forecast of rh")]
    daily = forecast_irrigation(train_all(df, config), history_pack(df), 365).cache()
    out = daily.toPandas()
    assert out.error.isna().all()
    assert sorted(out.model.unique()) == ["sarima", "var"]
    assert (out.groupby("model").size() == 365).all()
    assert out.day.min() == START + dt.timedelta(days=n)
    assert out.temp_c.between(-30, 60).all() and out.ET0.notna().all()
    totals = publish(daily, str(tmp_path / "results"), "csv").collect()
    assert {r["model"]: r["days"] for r in totals} == {"sarima": 365, "var": 365}
    assert sorted(p.name for p in (tmp_path / "results").glob("model=*")) == [
        "model=sarima", "model=var",
    ]


def test_first_order_by_hand(spark):
    x = np.cumsum(np.random.default_rng(2).normal(size=200))
    pairs = ar.differenced_pairs(table(spark, {1: x[:, None]}, ("rh",)), ("rh",))
    row = ar.fit(pairs).first()
    w = np.diff(x)
    slope, intercept = np.polyfit(w[:-1], w[1:], 1)
    assert (row["phi"], row["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))
    got = [r["value"] for r in ar.forecast(ar.fit(pairs), 5).orderBy("step").collect()]
    level, step = x[-1], w[-1]
    for value in got:
        step = intercept + slope * step
        level += step
        assert value == pytest.approx(level)


def test_first_order_without_a_mean(spark):
    """Differences 1, 2, 3, ... have slope one; the path keeps growing."""
    x = np.cumsum(np.arange(20.0))
    models = ar.fit(ar.differenced_pairs(table(spark, {1: x[:, None]}, ("rh",)), ("rh",)))
    got = [r["value"] for r in ar.forecast(models, 3).orderBy("step").collect()]
    assert got == pytest.approx(list(np.cumsum(np.arange(23.0))[-3:]))


def test_no_models(spark):
    df = table(spark, {1: seasonal_climate(100)}, NAMES)
    config = TrainConfig(families=("window",), test_size=99, variables=NAMES)
    with pytest.raises(ValueError, match="no trained models"):
        predict_all(train_all(df, config), history_pack(df, NAMES), 5)


def test_pack_is_ordered(spark):
    block = seasonal_climate(50)
    df = table(spark, {1: block}, NAMES).orderBy(F.rand(3))
    row = pack_series(df, NAMES).first()
    assert row["temp_c"] == list(block[:, 0]) and row["n"] == 50
    assert df.groupBy("station").agg(scales_map(NAMES)).count() == 1
