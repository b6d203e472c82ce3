"""Operators against pandas, NumPy and hand-computed points."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from acequia.functions import agronomy, naming
from acequia.functions.arrays import difference, shift_append, tail
from acequia.operators import calendar, reports, scaling, series
from acequia.plans.predict import horizon_days
from acequia.schema import CropParams, SCALER_KINDS, TrainConfig, scaler_kind

START = dt.date(2024, 1, 1)
ONE = ("temp_c",)


def days(n, start=START):
    return [start + dt.timedelta(days=i) for i in range(n)]


def frame(spark, rows, columns="station bigint, day date, temp_c double"):
    return spark.createDataFrame(rows, columns)


def values(df, column="temp_c"):
    return [r[column] for r in df.orderBy("station", "day").collect()]


def gappy(seed, n=120):
    """Two stations with missing days and missing readings, in random order."""
    rng = np.random.default_rng(seed)
    rows = []
    for station in (1, 2):
        for day in days(n):
            if rng.random() < 0.4:
                reading = None if rng.random() < 0.4 else float(rng.normal())
                rows.append((station, day, reading))
    return [rows[i] for i in rng.permutation(len(rows))]


def pandas_completed(rows):
    out = {}
    for station in sorted({r[0] for r in rows}):
        s = pd.Series(
            {pd.Timestamp(d): v for k, d, v in rows if k == station}, dtype=float
        ).sort_index()
        grid = s.reindex(pd.date_range(s.index.min(), s.index.max(), freq="D"))
        out[station] = grid.interpolate(method="time")
    return out


def test_interpolation_example(spark):
    given = [(1, None), (3, 1.0), (4, None), (8, 5.0), (10, None)]
    df = frame(spark, [(1, dt.date(2024, 1, d), v) for d, v in given])
    want = [None, None, 1.0, 1.8, 2.6, 3.4, 4.2, 5.0, 5.0, 5.0]
    for got in (
        values(calendar.interpolate_time(calendar.calendar_grid(df, ONE), ONE)),
        values(calendar.complete_series(df, ONE)),
    ):
        assert got[:2] == [None, None]
        assert got[2:] == pytest.approx(want[2:])
    assert values(calendar.whole_series(df, ONE)) == pytest.approx(want[2:])


@pytest.mark.parametrize("seed", range(4))
def test_completed_like_pandas(spark, seed):
    rows = gappy(seed)
    df = frame(spark, rows)
    want = pandas_completed(rows)
    for made in (
        calendar.complete_series(df, ONE),
        calendar.interpolate_time(calendar.calendar_grid(df, ONE), ONE),
    ):
        got = made.orderBy("station", "day").toPandas()
        for station, expected in want.items():
            mine = got[got.station == station]
            assert list(pd.to_datetime(mine.day)) == list(expected.index)
            np.testing.assert_allclose(mine.temp_c.to_numpy(float), expected.to_numpy(), rtol=1e-12)


def test_stations_do_not_mix(spark):
    rows = gappy(9)
    both = calendar.complete_series(frame(spark, rows), ONE)
    alone = calendar.complete_series(frame(spark, [r for r in rows if r[0] == 2]), ONE)
    assert values(both.filter("station = 2")) == values(alone)


def test_duplicate_day_is_an_error(spark):
    df = frame(spark, [(1, START, 1.0), (1, START, 2.0), (1, days(3)[2], 3.0)])
    assert calendar.duplicate_days(df).count() == 1
    with pytest.raises(Exception, match="duplicate day 2024-01-01 for station 1"):
        calendar.calendar_grid(df, ONE).collect()
    with pytest.raises(Exception, match="duplicate day"):
        calendar.complete_series(df, ONE).collect()


def test_edges(spark):
    empty = frame(spark, [])
    assert calendar.complete_series(empty, ONE).count() == 0
    assert values(calendar.complete_series(frame(spark, [(1, START, 4.0)]), ONE)) == [4.0]
    never = frame(spark, [(1, START, None), (1, days(3)[2], None)])
    assert values(calendar.complete_series(never, ONE)) == [None, None, None]
    assert calendar.whole_series(never, ONE).count() == 0
    no_day = frame(spark, [(1, None, 1.0), (1, START, 2.0)])
    assert values(calendar.calendar_grid(no_day, ONE)) == [2.0]


def test_nan_becomes_null(spark):
    df = calendar.nan_to_null(frame(spark, [(1, START, float("nan"))]), ONE)
    assert values(df) == [None]


@pytest.mark.parametrize(
    "day, kc",
    [(1, 0.4), (15, 0.4), (16, 0.41), (40, 0.65), (65, 0.9), (66, 0.9), (163, 0.9),
     (164, 0.9 - 0.25 / 31), (194, 0.65), (195, 0.65), (366, 0.65)],
)
def test_crop_coefficient(spark, day, kc):
    got = spark.range(1).select(agronomy.crop_coefficient(F.lit(day)).alias("kc")).first()["kc"]
    assert got == pytest.approx(kc)


@pytest.mark.parametrize("rain, want", [(3.0, 0.0), (3.01, 2.2575), (4.0, 3.0), (None, 0.0)])
def test_effective_rain(spark, rain, want):
    column = agronomy.effective_rain(F.lit(rain).cast("double"))
    assert spark.range(1).select(column.alias("x")).first()["x"] == pytest.approx(want)


@pytest.mark.parametrize("demand, want", [(1.0, 0.0), (4.0, 2.0), (None, None)])
def test_net_need(spark, demand, want):
    column = agronomy.net_need(F.lit(demand).cast("double"), F.lit(2.0))
    assert spark.range(1).select(column.alias("x")).first()["x"] == want


def weather(spark, n=400):
    rows = [
        (1, d, 930.0 + i % 7, 30.0, 1.0 + i % 4, 10.0 + i % 20, 1.2e7 + 1e4 * i, float(i % 9), 55.0)
        for i, d in enumerate(days(n))
    ]
    return frame(
        spark,
        rows,
        "station bigint, day date, pressure_hpa double, rh_min double, wind_ms double, "
        "temp_c double, rad_j double, precip_mm double, rh double",
    )


def test_irrigation_by_hand(spark):
    got = agronomy.calculate_irrigation(weather(spark)).orderBy("day").toPandas()
    row = got.iloc[100]
    es = 0.6108 * math.exp(17.27 * row.temp_c / (row.temp_c + 237.3))
    slope = 4098 * es / (row.temp_c + 237.3) ** 2
    gamma = 0.665e-3 * row.pressure_hpa * 0.1
    rn = 0.77 * row.rad_j / 1e6
    et0 = (0.408 * slope * rn + gamma * 900 / (row.temp_c + 273) * row.wind_ms * es * 0.45) / (
        slope + gamma * (1 + 0.34 * row.wind_ms)
    )
    assert row.ET0 == pytest.approx(et0)
    assert row.ETc == pytest.approx(0.9 * et0)
    rain = 0.75 * row.precip_mm if row.precip_mm > 3 else 0.0
    assert row.NB == pytest.approx(max(0.0, 0.9 * et0 - rain) / 0.95)
    assert row.NB_RDC == pytest.approx(max(0.0, 0.18 * et0 - rain) / 0.95)
    assert (got.NB_RDC <= got.NB).all()
    with pytest.raises(ValueError):
        agronomy.calculate_irrigation(weather(spark).limit(0))


def test_stage_deficit(spark):
    crop = CropParams(stage_deficit=(1.0, 0.5, 0.2, 0.5, 1.0))
    got = agronomy.with_irrigation(weather(spark, 366), crop).orderBy("day").toPandas()
    share = (got.ETc_RDC / got.ETc).round(9)
    assert share.iloc[[0, 20, 100, 170, 300]].tolist() == [1.0, 0.5, 0.2, 0.5, 1.0]


def test_scalers(spark):
    df = weather(spark).withColumn("rh_min", F.lit(5.0))
    pdf = df.toPandas()
    rows = {
        (r["variable"], r["kind"]): r
        for kind in (None, "minmax")
        for r in scaling.scale_rows(scaling.fit_scales(df, kind=kind)).collect()
    }
    t = rows["temp_c", "standard"]
    assert t["center"] == pytest.approx(pdf.temp_c.mean())
    assert t["scale"] == pytest.approx(pdf.temp_c.std(ddof=0))
    w, q = rows["wind_ms", "robust"], np.quantile(pdf.wind_ms, [0.25, 0.5, 0.75])
    assert (w["center"], w["scale"]) == (q[1], q[2] - q[0])
    assert rows["rh_min", "standard"]["scale"] == 1.0
    assert rows["rad_j", "minmax"]["scale"] == pytest.approx(np.ptp(pdf.rad_j))
    scales = scaling.fit_scales(df)
    scaled = scaling.apply_scales(df, scales)
    assert values(scaled, "rh_min") == [0.0] * 400
    back = scaling.invert_scales(scaled, scales)
    assert values(back, "rad_j") == pytest.approx(values(df, "rad_j"))


def line(spark, n, stations=(1,)):
    rng = np.random.default_rng(3)
    rows = [(k, d, float(x)) for k in stations for d, x in zip(days(n), rng.normal(size=n))]
    return frame(spark, rows)


def test_split(spark):
    df = line(spark, 100, (1, 2))
    train, test = series.temporal_train_test_split(df, 20)
    assert train.count() == 160 and test.count() == 40
    assert train.agg(F.max("day")).first()[0] < test.agg(F.min("day")).first()[0]
    bounds = series.split_bounds(df).filter("station = 1").first()
    assert (bounds["default_test"], bounds["min_test"], bounds["max_test"]) == (20, 10, 50)
    assert bounds["train_pct"] == pytest.approx(80.0)
    with pytest.raises(Exception, match="no training rows"):
        series.temporal_train_test_split(df, 180)[0].collect()


def test_sequences(spark):
    df = line(spark, 50)
    x = values(df)
    got = series.sliding_sequences(df, ONE, 30).orderBy("day").collect()
    assert len(got) == 20
    for i, row in enumerate(got):
        assert [s["temp_c"] for s in row["sequence"]] == x[i : i + 30]
        assert row["temp_c"] == x[i + 30]


def test_state_and_shift(spark):
    df = line(spark, 50)
    x = values(df)
    state = series.last_k(df, 5, ONE).first()
    assert [s["temp_c"] for s in state["state"]] == x[-5:]
    moved = spark.range(1).select(shift_append(F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.lit(9.0)))
    assert moved.first()[0] == [2.0, 3.0, 9.0]


@pytest.mark.parametrize("d, seasonal_d, period", [(1, 0, 7), (0, 1, 7), (1, 1, 7), (2, 1, 5), (2, 2, 4)])
def test_difference_and_integrate(spark, d, seasonal_d, period):
    n, h = 90, 20
    df = line(spark, n, (1, 2))
    reach = d + seasonal_d * period
    diffs = series.seasonal_difference(
        df.withColumn("level", F.col("temp_c")), ONE, d, seasonal_d, period
    )
    x = np.array(values(df.filter("station = 1")))
    want = x
    for _ in range(seasonal_d):
        want = want[period:] - want[:-period]
    want = np.diff(want, d)
    got = values(diffs.filter("station = 1"))
    assert got[:reach] == [None] * reach
    np.testing.assert_allclose(got[reach:], want, atol=1e-12)
    arrays = series.pack_series(df, ONE).select(
        "station",
        difference(F.col("temp_c"), d, seasonal_d, period).alias("w"),
        tail(F.col("temp_c"), 3).alias("t"),
    )
    one = arrays.filter("station = 1").first()
    np.testing.assert_allclose(one["w"], want, atol=1e-12)
    assert one["t"] == list(x[-3:])

    train, test = series.temporal_train_test_split(diffs, h)
    state = series.last_k(train, reach, ("level",)).select(
        "station", "last_day", F.transform("state", lambda s: s["level"]).alias("tail")
    )
    steps = test.join(state, "station").withColumn("step", F.datediff("day", "last_day"))
    levels = series.integrate_forecast(
        steps, ["station"], "temp_c", "tail", d, seasonal_d, period
    )
    np.testing.assert_allclose(values(levels.filter("station = 1")), x[-h:], atol=1e-9)


def test_exog_policies(spark):
    df = line(spark, 10)
    x = values(df)

    def future(h, policy):
        rows = series.exog_future(df, ONE, h, policy).orderBy("step").collect()
        assert [r["step"] for r in rows] == list(range(1, h + 1))
        return [r["temp_c"] for r in rows]

    assert future(4, "hold") == [x[-1]] * 4
    assert future(4, "head") == x[:4]
    assert future(12, "head") == [x[-1]] * 12
    with pytest.raises(ValueError):
        series.exog_future(df, ONE, 3, "other")


def test_head_tail_and_summary(spark):
    df = line(spark, 10)
    x = values(df)
    got = {(r["part"], r["pos"]): r["temp_c"] for r in reports.head_tail(df, 3).collect()}
    assert got == {("head", i + 1): x[i] for i in range(3)} | {
        ("tail", i + 1): x[-1 - i] for i in range(3)
    }
    summary = reports.series_summary(df, ONE).first()
    assert (summary["n_rows"], summary["first_day"], summary["last_day"]) == (
        10, "2024-01-01", "2024-01-10",
    )


def test_unify_keeps_complete_days(spark):
    long = spark.createDataFrame(
        [("m", 1, START, "a", 1.0), ("m", 1, START, "b", 2.0), ("m", 1, days(2)[1], "a", 3.0)],
        "model string, station bigint, day date, variable string, value double",
    )
    got = reports.unify_forecasts(long, columns=("a", "b")).collect()
    assert [(r["day"], r["a"], r["b"]) for r in got] == [(START, 1.0, 2.0)]
    missing = reports.missing_variables(long, ("model", "day"), ("a", "b")).collect()
    assert [(r["day"], r["missing"]) for r in missing] == [(days(2)[1], ["b"])]


def test_names(spark):
    assert naming.date_column(["x", "La FECHA", "Fecha"]) == "La FECHA"
    with pytest.raises(ValueError):
        naming.date_column(["day"])
    assert scaler_kind("Precipitaciones") == "robust" and scaler_kind("Temperatura") == "standard"
    assert sorted(k for k, v in SCALER_KINDS.items() if v == "robust") == [
        "precip_mm", "pressure_hpa", "wind_ms",
    ]
    with pytest.raises(ValueError, match="missing climate columns"):
        naming.canonical_names(spark.range(1))


def test_settings():
    assert horizon_days() == 30 and horizon_days(400, max_horizon=500) == 400
    for asked in (0, 400):
        with pytest.raises(ValueError, match="horizon"):
            horizon_days(asked)
    with pytest.raises(ValueError):
        TrainConfig(families=("prophet",))
    with pytest.raises(ValueError):
        TrainConfig(test_size=-1)


def test_two_forecasts_of_one_variable_are_an_error(spark):
    rows = [("m", 1, "a", 1.0), ("m", 1, "b", 2.0), ("m", 1, "a", 3.0)]
    long = spark.createDataFrame(rows, "model string, station long, variable string, value double")
    with pytest.raises(Exception, match="two forecasts of one variable"):
        reports.unify_forecasts(long, ("model", "station"), ("a", "b")).collect()


def test_rows_counted_as_they_are_computed(spark):
    for rows, many in ((weather(spark), True), (weather(spark).limit(0), False)):
        seen = Observation()
        got = agronomy.calculate_irrigation(rows, observed=seen).collect()
        if many:
            assert agronomy.require_rows(seen) == len(got)
        else:
            with pytest.raises(ValueError, match="no forecast rows"):
                agronomy.require_rows(seen)
