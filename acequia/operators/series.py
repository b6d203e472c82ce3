"""Operators over ordered daily series: splits, lags, sequences, differencing."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acequia.functions.arrays import difference, tail
from acequia.operators import packs
from acequia.schema import DAY, KEY, VARIABLES


def _by_day(key=KEY):
    return Window.partitionBy(key).orderBy(DAY)


# --- splits ---------------------------------------------------------------


def label_split(df: DataFrame, test_size: int) -> DataFrame:
    """Add ``split``: 'test' for the last ``test_size`` rows of a station, else 'train'.

    A station with no row left to train on is labelled 'short' throughout.
    """
    # forwards, as lags and differences are: they share one sort with the rank
    forwards = _by_day()
    total = F.count(F.lit(1)).over(
        forwards.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    from_end = total - F.row_number().over(forwards) + 1
    return df.withColumn(
        "split",
        F.when(total <= test_size, F.lit("short"))
        .when(from_end <= test_size, F.lit("test"))
        .otherwise(F.lit("train")),
    )


def labelled_split(df: DataFrame, test_size: int) -> DataFrame:
    """``df`` with ``split`` 'train' or 'test'; a test part as long as a series raises."""
    if test_size < 0:
        raise ValueError("test_size must not be negative")
    problem = F.concat_ws(" ", F.lit("test_size leaves no training rows for station"),
                          F.col(KEY).cast("string"))
    short = F.when(F.col("split") == "short", F.raise_error(problem).cast("string"))
    return label_split(df, test_size).withColumn("split", short.otherwise(F.col("split")))


def temporal_train_test_split(df: DataFrame, test_size: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) frames; who needs both at once reads ``labelled_split`` instead."""
    labelled = labelled_split(df, test_size)
    return (
        labelled.filter(F.col("split") == "train").drop("split"),
        labelled.filter(F.col("split") == "test").drop("split"),
    )


def split_bounds(df: DataFrame) -> DataFrame:
    """Default, smallest and largest test size per station, and the default train share."""
    n = F.col("n")

    def share(fraction: float) -> Column:
        return F.floor(n * F.lit(fraction) + F.lit(0.5)).cast("bigint")

    return (
        df.groupBy(KEY)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            KEY,
            n,
            share(0.20).alias("default_test"),
            share(0.10).alias("min_test"),
            share(0.50).alias("max_test"),
        )
        .withColumn("train_pct", (n - F.col("default_test")) / n * F.lit(100.0))
    )


# --- lags and differences -------------------------------------------------


def lag_matrix(df: DataFrame, columns, maxlags: int) -> DataFrame:
    """Add ``{column}_lag{i}`` for i in 1..maxlags.

    ``df`` are rows, or an ``observed_pack`` to be completed, whose days are never sorted as rows.
    """
    if packs.is_observed(df):
        return packs.lagged_days(df, columns, maxlags)
    window = _by_day()
    return df.withColumns(
        {
            f"{c}_lag{i}": F.lag(c, i).over(window)
            for c in columns
            for i in range(1, maxlags + 1)
        }
    )


def difference_weights(d: int, seasonal_d: int, period: int) -> dict[int, int]:
    """Weights of x[t-lag] in the differenced value, by lag."""
    weights: dict[int, int] = {}
    for i in range(d + 1):
        for j in range(seasonal_d + 1):
            lag = i + j * period
            sign = (-1) ** (i + j)
            weights[lag] = weights.get(lag, 0) + sign * comb(d, i) * comb(seasonal_d, j)
    return weights


def seasonal_difference(
    df: DataFrame, columns=VARIABLES, d: int = 1, seasonal_d: int = 1, period: int = 30
) -> DataFrame:
    """Replace columns by their ordinary and seasonal differences.

    All lags share one window; the first d + D*period rows become null.
    """
    window = _by_day()
    weights = difference_weights(d, seasonal_d, period)

    def diff(c: str) -> Column:
        out = None
        for lag, weight in weights.items():
            term = (F.lag(c, lag).over(window) if lag else F.col(c)) * F.lit(float(weight))
            out = term if out is None else out + term
        return out

    return df.withColumns({c: diff(c) for c in columns})


def difference_seeds(levels: Column, d: int, seasonal_d: int, period: int):
    """What undoing the differences needs from the end of the level series.

    Returns (last value of each ordinary difference order, last ``period``
    values of each seasonal order), both from the highest order down.
    """
    seasonal = [difference(levels, 0, k, period) for k in range(seasonal_d)]
    base = difference(levels, 0, seasonal_d, period)
    ordinary = [difference(base, k, 0, period) for k in range(d)]
    return (
        [F.element_at(o, -1) for o in reversed(ordinary)],
        [tail(x, period) for x in reversed(seasonal)],
    )


def integrate_forecast(
    steps: DataFrame,
    keys: list[str],
    value: str = "value",
    levels: str = "tail",
    d: int = 1,
    seasonal_d: int = 1,
    period: int = 30,
) -> DataFrame:
    """Turn forecast differences into levels.

    ``steps`` holds ``keys``, ``step`` (1..h), the differenced forecast and an
    array with the last d + D*period observed levels. Ordinary differences are
    undone by a running sum, seasonal ones by a running sum per residue of the
    step, all under one partitioning by ``keys``.
    """
    last_values, last_seasons = difference_seeds(F.col(levels), d, seasonal_d, period)
    residue = F.pmod(F.col("step") - 1, F.lit(period))
    seeds = {f"_last_{i}": seed for i, seed in enumerate(last_values)}
    seeds |= {f"_season_{i}": F.element_at(x, (residue + 1).cast("int")) for i, x in enumerate(last_seasons)}
    # Each step takes its own numbers from the arrays first, so that no window has to sort arrays.
    out = steps.withColumns(seeds) if seeds else steps
    along = (
        Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    )
    for i in range(len(last_values)):
        out = out.withColumn(value, F.col(f"_last_{i}") + F.sum(value).over(along))
    within = (
        Window.partitionBy(*keys, residue)
        .orderBy("step")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    for i in range(len(last_seasons)):
        out = out.withColumn(value, F.col(f"_season_{i}") + F.sum(value).over(within))
    return out.drop(*seeds)


# --- sequences and state --------------------------------------------------


def sliding_sequences(df: DataFrame, columns=VARIABLES, length: int = 30) -> DataFrame:
    """Rows with the ``length`` previous rows as ``sequence``; shorter histories drop out.

    ``df`` are rows, or an ``observed_pack`` to be completed, whose days are never sorted as rows.
    """
    if packs.is_observed(df):
        return packs.preceded_days(df, columns, length)
    before = _by_day().rowsBetween(-length, -1)
    return df.withColumn(
        "sequence", F.collect_list(F.struct(*columns)).over(before)
    ).filter(F.size("sequence") == length)


def last_days(df: DataFrame, days: int) -> DataFrame:
    """The rows of each station's last ``days`` calendar days."""
    whole = _by_day().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = F.datediff(F.max(DAY).over(whole), DAY) < days
    return df.withColumn("_near", near).filter("_near").drop("_near")


def last_k(df: DataFrame, k: int, columns=VARIABLES) -> DataFrame:
    """Per station the last k rows, oldest first, as ``state``, and ``last_day``."""
    from_end = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(DAY)))
    return (
        df.withColumn("_rn", from_end)
        .filter(F.col("_rn") <= k)
        .groupBy(KEY)
        .agg(
            F.max(DAY).alias("last_day"),
            F.sort_array(F.collect_list(F.struct(DAY, *columns))).alias("state"),
        )
    )


def exog_future(df: DataFrame, columns, horizon: int, policy: str = "hold") -> DataFrame:
    """Regressor rows for steps 1..horizon.

    'hold' repeats the last row. 'head' takes the first ``horizon`` rows of the
    history, and repeats the last row where the history is shorter than that.
    """
    first = F.row_number().over(_by_day())
    from_end = F.row_number().over(Window.partitionBy(KEY).orderBy(F.desc(DAY)))
    if policy == "hold":
        held = df.withColumn("_end", from_end).filter(F.col("_end") == 1)
    elif policy == "head":
        total = F.count(F.lit(1)).over(Window.partitionBy(KEY))
        ranked = df.withColumns({"_first": first, "_end": from_end, "_n": total})
        held = ranked.filter((F.col("_end") == 1) & (F.col("_n") < horizon))
    else:
        raise ValueError(f"unknown exog policy {policy!r}")
    tiled = held.select(
        KEY, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), *columns
    )
    if policy == "hold":
        return tiled
    head = ranked.filter((F.col("_n") >= horizon) & (F.col("_first") <= horizon)).select(
        KEY, F.col("_first").alias("step"), *columns
    )
    return head.unionByName(tiled)


def pack_series(df: DataFrame, columns=VARIABLES) -> DataFrame:
    """One row per station: first and last day, length, and an array per column.

    The array is bounded by the calendar span because the series has one row
    per day. After ``complete_series`` the rows are already partitioned by
    station, so this adds no exchange.
    """
    row = F.sort_array(F.collect_list(F.struct(DAY, *columns))).alias("_rows")
    return (
        df.groupBy(KEY)
        .agg(
            F.min(DAY).alias("first_day"),
            F.max(DAY).alias("last_day"),
            F.count(F.lit(1)).alias("n"),
            row,
        )
        .withColumns({c: F.col(f"_rows.{c}") for c in columns})
        .drop("_rows")
    )
