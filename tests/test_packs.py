"""Packs hold observed days, and complete them as the row-wise operators do."""

import datetime

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from acequia import catalog, session
from acequia.models import linear, var
from acequia.models.family import register, series_family, unregister
from acequia.operators import packs, scaling, series
from acequia.operators.calendar import whole_series
from acequia.plans.predict import history_pack
from acequia.plans.train import beside_pack, fit_family, spread_pack, train_all, training_pack
from acequia.schema import DAY, KEY, TrainConfig
from acequia.sources import export

NAMES = ("temp_c", "wind_ms")
FIRST = datetime.date(2020, 1, 1)


def day(n):
    return FIRST + datetime.timedelta(days=n)


def readings(spark, rows):
    schema = f"{KEY} bigint, {DAY} date, temp_c double, wind_ms double"
    return spark.createDataFrame([(s, None if d is None else day(d), t, w) for s, d, t, w in rows], schema)


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(3)
    rows = [(1, d, *rng.normal(size=2).tolist()) for d in range(0, 90, 3)]
    rows += [(2, 0, None, 1.0), (2, 4, 2.0, None), (2, 5, None, 3.5), (2, 11, 0.1, 4.0), (2, 12, None, None)]
    rows += [(3, 7, None, 1.0), (3, 9, None, 2.0)]  # never whole
    rows += [(4, 0, 0.1, 5.0), (4, 6, 0.1, 5.0)]  # constant
    rows += [(None, 1, 1.0, 2.0), (None, 3, 2.0, 2.0), (5, None, 1.0, 1.0)]
    return readings(spark, rows)


def test_pack_is_the_completed_series(odd):
    want = {}
    for r in whole_series(odd, NAMES).orderBy(KEY, DAY).collect():
        want.setdefault(r[KEY], []).append(tuple(r[c] for c in (DAY, *NAMES)))
    got = {r[KEY]: r for r in history_pack(odd, NAMES).collect()}
    assert got.keys() == want.keys()
    for key, rows in want.items():
        assert (got[key]["first_day"], got[key]["last_day"], got[key]["n"]) == (rows[0][0], rows[-1][0], len(rows))
        for i, c in enumerate(NAMES):
            assert got[key][c] == [r[i + 1] for r in rows]


def test_scalers_are_those_of_the_rows(odd):
    pack = training_pack(odd, TrainConfig(variables=NAMES, test_size=0))
    for column, kind in (("scales", None), ("ranges", "minmax")):
        want = {r[KEY]: r["scales"] for r in scaling.fit_scales(whole_series(odd, NAMES), NAMES, kind).collect()}
        for r in pack.filter("n > 0").collect():
            for c in NAMES:
                assert r[column][c]["kind"] == want[r[KEY]][c]["kind"]
                for part in ("center", "scale"):
                    assert r[column][c][part] == pytest.approx(want[r[KEY]][c][part], rel=1e-12, abs=1e-12)
    lost = pack.filter("n = 0").collect()
    assert [(r[KEY], r["n_rows"], r["last_day"], r["temp_c"]) for r in lost] == [(3, 3, None, [])]


def test_test_part_is_left_out(odd):
    packed = {r[KEY]: r for r in training_pack(odd, TrainConfig(variables=NAMES, test_size=5)).collect()}
    assert (packed[1]["n"], packed[1]["last_day"]) == (83, day(82))
    assert packed[None]["n"] == 0  # as long as its series
    assert packed[4]["n"] == 2


def test_doubled_day_raises(spark):
    twice = readings(spark, [(1, 0, 1.0, 1.0), (1, 0, 2.0, 2.0)])
    with pytest.raises(Exception, match="duplicate day 2020-01-01 for station 1"):
        training_pack(twice, TrainConfig(variables=NAMES)).collect()


def test_only_observed_days_are_written_and_joined(spark):
    """Two readings years apart: what travels holds two days, not all between."""
    far = readings(spark, [(1, 0, 1.0, 2.0), (1, 3000, 4.0, 2.0)])
    pack, stations = spread_pack(far, TrainConfig(variables=NAMES, test_size=0))
    observed, _, _ = pack._spread
    assert stations == 1 and observed.select(F.size("temp_c")).first()[0] == 2
    rows = beside_pack(pack, spark.range(1, 3).select(F.col("id").alias(KEY), F.lit("a").alias("mark")))
    assert [(r[KEY], r["mark"], len(r["temp_c"])) for r in rows.collect()] == [(1, "a", 3001)]
    history = history_pack(far, NAMES)
    assert packs.counted(history) == 1
    assert history._observed[0].select(F.size("wind_ms")).first()[0] == 2


def test_row_groups_of_written_packs_are_bounded(spark):
    """A reader holds a row group's stations at most, not 4,096 of them."""
    days = F.sequence(F.lit(0), F.lit(1500))
    wide = spark.range(0, 600, 1, 1).select(
        F.col("id").alias(KEY), F.transform(days, lambda d: F.rand(1) + d).alias("temp_c"),
    )
    [path] = session.materialize(wide, "wide").inputFiles()
    file = pq.ParquetFile(path.removeprefix("file:"))
    sizes = [file.metadata.row_group(i).total_byte_size for i in range(file.num_row_groups)]
    assert len(sizes) > 1 and max(sizes) < 2 * session.GROUP_BYTES


def test_one_pack_serves_training_and_history(spark, odd):
    """Readings are packed and written once where both are asked for."""
    packed = packs.observed_series(odd, NAMES)
    pack, stations = spread_pack(packed, TrainConfig(variables=NAMES, test_size=0))
    history = history_pack(packed, NAMES)
    assert pack._spread[0] is packed and history._observed[0] is packed
    assert stations == packs.counted(history) == packed.count()
    assert sorted(map(repr, history.collect())) == sorted(map(repr, history_pack(odd, NAMES).collect()))


def test_models_meet_their_history_in_bounded_tasks(spark, odd):
    """The join's tasks are the ones asked for: they hold whole series, few bytes of which are moved."""
    history = history_pack(odd, NAMES)
    models = spark.createDataFrame([(1, 2), (2, None), (3, 1), (9, 4)], f"{KEY} bigint, p int")
    joined = packs.with_history(models, history, NAMES, last="p")
    assert joined.rdd.getNumPartitions() >= session.task_count(spark)
    whole = {r[KEY]: r for r in history.collect()}
    for r in joined.collect():
        if r[KEY] == 9:
            assert r["last_day"] is None and r["temp_c"] == []
        else:
            days = r["p"] or 1
            assert r["temp_c"] == (whole[r[KEY]]["temp_c"][-days:] if r[KEY] in whole else [])


def test_batches_of_many_stations(spark, odd, monkeypatch):
    """Slices of a batch hold their own stations."""
    monkeypatch.setattr(packs, "BATCH_STATIONS", 2)
    rows = readings(spark, [(s, d, float(s + d), float(s * d)) for s in range(7) for d in (0, 2, 5)]).coalesce(1)
    got = {r[KEY]: r["temp_c"] for r in history_pack(rows, NAMES).collect()}
    assert got == {s: [float(s + d) for d in range(6)] for s in range(7)}


@pytest.mark.parametrize("most", (4096, 7))
def test_lags_and_sequences_of_packs_are_those_of_rows(odd, most, monkeypatch):
    """The same rows, and no calendar day is sorted or exchanged as a row."""
    monkeypatch.setattr(packs, "BATCH_DAYS", most)
    rows, pack = whole_series(odd, NAMES), packs.observed_pack(odd, NAMES)
    for operator, reach in ((series.lag_matrix, 3), (series.sliding_sequences, 4)):
        want, got = operator(rows, NAMES, reach), operator(pack, NAMES, reach)
        assert got.columns == want.columns
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Window [" not in plan and plan.count("Exchange hashpartitioning") == 1
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_known_stations_are_not_exchanged_again(spark):
    far = readings(spark, [(1, d, float(d % 5), float(d % 3)) for d in range(200)])
    config = TrainConfig(families=("var",), variables=NAMES, maxlags=2, test_size=0)
    plan = train_all(far, config)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1


def test_export_does_not_move_rows_by_model(spark):
    rows = spark.createDataFrame([("sarima", 1), ("var", 2)], "model string, station bigint")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = export.with_sheets(rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_error_sums_by_definition():
    rng = np.random.default_rng(5)
    season, w, coef = 3, rng.normal(size=(2, 20)), np.array([[0.1, 0.3, -0.4, 0.2, 0.5], [0.0, -0.2, 0.6, 0.1, -0.3]])
    for const in (True, False):
        given = coef if const else coef[:, 1:]
        got = catalog._error_sums(w, given, season, const)
        for row, (c, phi, theta, sphi, stheta), sse in zip(w, coef, got):
            e, c = [0.0] * 20, c if const else 0.0
            for t in range(season + 1, 20):
                mean = c + phi * row[t - 1] + sphi * row[t - season] - phi * sphi * row[t - season - 1]
                mean += theta * e[t - 1] + stheta * e[t - season] + theta * stheta * e[t - season - 1]
                e[t] = row[t] - mean
            assert sse == pytest.approx(sum(x * x for x in e))


FITTED = ("sarima", "sarimax", "var", "window", "mean")


@pytest.mark.parametrize("name", FITTED)
def test_spread_stations_are_completed_where_they_are_fitted(spark, odd, name):
    """One Python task from observed days to coefficients, the rows being those of a plain pack."""
    if name == "mean":
        register(series_family("mean", lambda x, _: [x.mean()], lambda c, s, h, _: [c[0]] * h, state_days=1))
    try:
        config = TrainConfig(
            families=(name,), variables=NAMES, order=(1, 0, 0), seasonal=(0, 0, 0, 0), maxlags=2, window=3, test_size=2
        )
        pack, stations = spread_pack(odd, config)
        got = fit_family(pack, config, name, stations).drop("trained_at")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan
        want = fit_family(training_pack(odd, config), config, name).drop("trained_at")
        near = [F.transform("coef", lambda x: F.round(x, 9)).alias("coef"), F.round("sigma2", 9).alias("sigma2")]
        rest = [c for c in want.columns if c not in ("coef", "sigma2")]
        assert got.schema == want.schema
        got, want = (sorted(map(repr, df.select(*rest, *near).collect())) for df in (got, want))
        assert got == want and len(got) == 5 * (1 if name in ("var", "window") else 2)
    finally:
        if name == "mean":
            unregister("mean")


def test_moments_of_spread_stations(spark, odd):
    """Stations no longer than the lags have no moments, from either kind of pack."""
    config = TrainConfig(variables=NAMES, test_size=0)
    pack, stations = spread_pack(odd, config)
    for scales in ("scales", None):
        got = {r[KEY]: r for r in var.moments(pack, NAMES, 7, scales, stations).collect()}
        want = {r[KEY]: r for r in var.moments(training_pack(odd, config), NAMES, 7, scales).collect()}
        assert got.keys() == want.keys() == {1, 2}
        for key, row in want.items():
            assert got[key]["n"] == row["n"]
            np.testing.assert_allclose(got[key]["gram"], row["gram"], rtol=1e-12)
            np.testing.assert_allclose(got[key]["head"], row["head"], rtol=1e-12)


@pytest.mark.parametrize(("days", "k", "lags"), ((200, 7, 30), (101, 3, 5), (12, 2, 3), (9, 1, 0), (5, 2, 4)))
def test_products_with_each_lag_by_definition(days, k, lags):
    block = np.random.default_rng(days).normal(size=(days, k))
    want = [block[lags:].T @ block[lags - j : days - j] for j in range(lags + 1)]
    np.testing.assert_allclose(linear.today_products(block, lags), want, rtol=0, atol=1e-11)
    z = linear.lagged_terms(block, lags)
    np.testing.assert_allclose(linear.cross_products(block, lags), z.T @ z, rtol=0, atol=1e-11)
