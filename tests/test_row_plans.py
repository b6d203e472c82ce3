"""Plans of row-wise operators: what a task holds and sorts, beside the values."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from acequia.operators import scaling, series
from acequia.schema import DAY, KEY

START = dt.date(2024, 1, 1)
SCHEMA = f"{KEY} bigint, {DAY} date, temp_c double, wind_ms double"


def days(spark, readings):
    """Rows of (station, [(temp_c, wind_ms), ...]) from the first of January."""
    rows = [
        (station, START + dt.timedelta(i), *pair) for station, pairs in readings for i, pair in enumerate(pairs)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


def test_scaled_rows_are_not_collected_in_an_aggregate(spark):
    columns = ("temp_c", "wind_ms")
    rows = days(
        spark,
        [
            (1, [(1.0, 4.0), (None, 1.5), (6.0, None), (2.5, 9.0)]),
            (2, [(3.0, None), (3.0, None)]),
            (None, [(1.0, 2.0), (4.0, 8.0)]),
        ],
    )
    scaled = scaling.fit_and_scale(rows, columns)
    assert "collect_list" not in plan(scaled) and "percentile" not in plan(scaled)
    want = scaling.apply_scales(rows, scaling.fit_scales(rows, columns), columns)
    key = [KEY, DAY]
    got = scaled.filter(F.col(KEY).isNotNull()).orderBy(key).collect()
    for a, b in zip(got, want.orderBy(key).collect(), strict=True):
        assert a[:2] == b[:2]
        for x, y in zip(a[2:], b[2:], strict=True):
            assert x == y or np.isclose(x, y, rtol=0, atol=1e-12)
    lone = scaled.filter(F.col(KEY).isNull()).orderBy(DAY).collect()
    assert [r["temp_c"] for r in lone] == [-1.0, 1.0]
    assert [r["wind_ms"] for r in lone] == [-1.0, 1.0]  # median 5, quartiles 3.5 and 6.5
    back = scaling.fit_and_scale(rows, columns, undo=True).filter(f"{KEY} = 1").orderBy(DAY).collect()
    assert [r["temp_c"] for r in back][1] is None
    np.testing.assert_allclose([r["temp_c"] for r in back if r["temp_c"] is not None], [1.0, 6.0, 2.5])


def test_split_shares_the_sort_of_differences(spark):
    rows = days(spark, [(1, [(float(i * i), 1.0) for i in range(12)]), (2, [(0.0, 1.0)])])
    labelled = series.label_split(series.seasonal_difference(rows, ("temp_c",), 1, 1, 3), 4)
    # all windows are in one order, so the plan has one sort of the calendar days
    orders = [line for line in physical(labelled).splitlines() if "Window" in line]
    assert orders and not any("DESC" in line for line in orders)
    parts = [r["split"] for r in labelled.filter(f"{KEY} = 1").orderBy(DAY).collect()]
    assert parts == ["train"] * 8 + ["test"] * 4
    assert labelled.filter(f"{KEY} = 2").first()["split"] == "short"


def test_last_days_of_each_station(spark):
    rows = days(spark, [(1, [(float(i), 1.0) for i in range(9)]), (2, [(7.0, 1.0)])])
    found = series.last_days(rows, 3).orderBy(KEY, DAY).collect()
    assert [(r[KEY], r["temp_c"]) for r in found] == [(1, 6.0), (1, 7.0), (1, 8.0), (2, 7.0)]


def test_integration_sorts_no_arrays(spark):
    steps = spark.range(1, 5).select(
        F.lit(1).cast("bigint").alias(KEY), F.col("id").cast("int").alias("step"),
        F.lit(2.0).alias("value"), F.array(*[F.lit(float(i * i)) for i in range(4)]).alias("tail"),
    )
    out = series.integrate_forecast(steps, [KEY], d=1, seasonal_d=1, period=3).select("step", "value")
    windows = [line for line in plan(out).splitlines() if "Window" in line or "Sort" in line]
    below = plan(out)[plan(out).rindex("Window") :].splitlines()[1]
    assert windows and "_season_0" in below and " AS tail" not in below
    levels, found = [0.0, 1.0, 4.0, 9.0], []
    for _ in range(4):  # x[t] = w + x[t-1] + x[t-3] - x[t-4]
        levels.append(2.0 + levels[-1] + levels[-3] - levels[-4])
    for row in out.orderBy("step").collect():
        found.append(row["value"])
    np.testing.assert_allclose(found, levels[4:])
