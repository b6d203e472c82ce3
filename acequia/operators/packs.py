"""Packed series: one row per station, its observed days on disk, its calendar days in flight.

A table of observed days is as large as the readings; completed series are longer
by every day without one. So what jobs exchange, write and read again are the
observed days, and each task completes the stations it holds, a batch at a time.
The rules are those of ``calendar.complete_series``: straight lines between
readings, the last one held, nothing before the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acequia.operators.scaling import scaler_of, scales_of_arrays
from acequia.schema import DAY, KEY, SCALER_KINDS
from acequia.session import materialize_counted, ship_package, task_count

#: Stations completed at once.
BATCH_STATIONS = 32
#: Series (a variable of a station) for one task.
SERIES_PER_TASK = 512
#: Days of a station that leave a task at once as rows.
BATCH_DAYS = 4096
_DAYS = "_days"
_SCALERS = ("_centers", "_widths", "_lows", "_spans")


def observed_pack(df: DataFrame, columns) -> DataFrame:
    """One row per station: its observed days and the readings of each column, in order."""
    rows = F.sort_array(F.collect_list(F.struct(DAY, *columns))).alias("_rows")
    return (
        df.filter(F.col(DAY).isNotNull())
        .groupBy(KEY)
        .agg(rows)
        .select(KEY, F.col(f"_rows.{DAY}").alias(_DAYS), *[F.col(f"_rows.{c}").alias(c) for c in columns])
    )


def observed_series(df: DataFrame, columns) -> DataFrame:
    """The ``observed_pack`` of ``df``, written and counted once for all that take packs.

    ``training_pack``, ``train_all`` and ``history_pack`` accept it in place of ``df``.
    """
    observed, seen = materialize_counted(observed_pack(df, columns), "observed-days")
    observed._packed = list(columns), seen["rows"]
    return observed


def packed(df: DataFrame, columns) -> tuple[DataFrame, int]:
    """Written observed days of ``columns`` and their stations; ``df`` may be an ``observed_series``."""
    if not set(columns) <= set(getattr(df, "_packed", ((), 0))[0]):
        df = observed_series(df, columns)
    return df, df._packed[1]


def complete(days: np.ndarray, values: np.ndarray, known: np.ndarray) -> tuple[int, np.ndarray]:
    """A column on the days from a station's first to its last.

    ``days`` count from the first, ``known`` tells which readings are there.
    Returns the first day with a value and the values from it on.
    """
    length = int(days[-1]) + 1
    at, v = days[known], values[known]
    if not len(at):
        return length, np.empty(0)
    # The line from a reading is v + slope * days since, here as in ``calendar``; the last reading is held.
    return int(at[0]), np.interp(np.arange(at[0], length), at, v)


def _station(station, days: np.ndarray, readings, test_size: int, kinds, scaled: bool):
    """(n_rows, n, first and last day), scalers if ``scaled``, series of the days that are whole and train."""
    same = np.flatnonzero(days[1:] == days[:-1])
    if len(same):
        day = np.datetime64(int(days[same[0]]), "D")
        raise ValueError(f"duplicate day {day} for station {station}")
    begin, length = int(days[0]), int(days[-1] - days[0]) + 1
    filled = [complete(days - begin, v, known) for v, known in readings]
    first = max([0, *[at for at, _ in filled]])
    end = length if length > test_size else 0
    end -= min(test_size, end)
    n = max(end - first, 0)
    if not n:
        return (length, 0, None, None), [[None] * len(kinds)] * len(_SCALERS), [np.empty(0)] * len(filled)
    series = [x[first - at : end - at] for at, x in filled]
    if not scaled:
        return (length, n, begin + first, begin + end - 1), [None] * len(_SCALERS), series
    own = [scaler_of(x, kind) for x, kind in zip(series, kinds)]
    ranges = [scaler_of(x, "minmax") for x in series]
    scalers = [[a for a, _ in own], [b for _, b in own], [a for a, _ in ranges], [b for _, b in ranges]]
    return (length, n, begin + first, begin + end - 1), scalers, series


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.append(0, np.cumsum([len(x) for x in parts]))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts), pa.float64()))


def _stations(batch: pa.RecordBatch, columns, test_size: int = 0, kinds: Sequence[str] = (), scaled: bool = False):
    """``_station`` of each row of an observed pack, None in place of series for one without days."""
    lists = batch.column(_DAYS)
    bounds, there = lists.offsets.to_numpy(), lists.is_valid().to_numpy(zero_copy_only=False)
    days = lists.values.cast(pa.int32()).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = []
    for c in columns:
        values = batch.column(c).values
        known = values.is_valid().to_numpy(zero_copy_only=False)
        # Readings have the offsets of their days.
        flat.append((batch.column(c).offsets.to_numpy(), values.to_numpy(zero_copy_only=False), known))
    for i, key in enumerate(batch.column(KEY).to_pylist()):
        if not there[i] or bounds[i] == bounds[i + 1]:
            yield (None,) * 4, [None] * len(_SCALERS), None
            continue
        readings = [(v[o[i] : o[i + 1]], k[o[i] : o[i + 1]]) for o, v, k in flat]
        yield _station(key, days[bounds[i] : bounds[i + 1]], readings, test_size, kinds, scaled)


def completed(
    observed: DataFrame, columns: Sequence[str], test_size: int = 0, keep: Sequence[str] = (), last: str | None = None,
    scaled: bool = False,
) -> DataFrame:
    """Each row's station with its completed series, from the first day with all columns.

    ``observed`` has the columns of an ``observed_pack`` and those of ``keep``, which
    pass through. The last ``test_size`` days are left out, and all of a series no
    longer than that. A row without days, or without a whole one, has no last day.
    ``last`` names a column of ``keep``: so many days of a series leave the task, at
    its end; null leaves one. Scalers are found where ``scaled`` asks for them.
    """
    ship_package(observed.sparkSession)
    columns, keep = list(columns), [KEY, *keep]
    kinds = [SCALER_KINDS.get(c, "standard") for c in columns]
    numbers = ("n_rows", "n")
    spark_type = T.ArrayType(T.DoubleType())
    schema = T.StructType([
        *[observed.schema[c] for c in keep],
        *[T.StructField(c, T.LongType()) for c in numbers],
        *[T.StructField(c, T.DateType()) for c in ("first_day", "last_day")],
        *[T.StructField(c, spark_type) for c in (*_SCALERS, *columns)],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Readings are unpacked once a batch: those of a slice are those of the whole.
            found = _stations(whole, columns, test_size, kinds, scaled)
            for at in range(0, whole.num_rows, BATCH_STATIONS):
                batch = whole.slice(at, BATCH_STATIONS)
                heads, scalers, series = zip(*islice(found, batch.num_rows))
                if last:
                    days = [max(k or 1, 1) for k in batch.column(last).to_pylist()]
                    series = [s and [x[-k:] for x in s] for k, s in zip(days, series)]
                made = [batch.column(c) for c in keep]
                for j, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32())):
                    column = pa.array([h[j] for h in heads], kind)
                    made.append(column.cast(pa.date32()) if j > 1 else column)
                made += [pa.array([s[j] for s in scalers], pa.list_(pa.float64())) for j in range(len(_SCALERS))]
                made += [
                    _lists([np.empty(0) if s is None else s[j] for s in series]) for j in range(len(columns))
                ]
                yield pa.RecordBatch.from_arrays(made, schema.names)

    return observed.select(*keep, _DAYS, *columns).mapInArrow(run, schema)


def _day_rows(observed: DataFrame, columns: Sequence[str], more: list[T.StructField], made, skipped: int) -> DataFrame:
    """Rows (station, day, columns, ``more``) of completed series, without their first ``skipped`` days.

    ``made(series, at, to)`` gives the further columns of days ``at`` to ``to``. Days come in
    order from the task that completes them, so that no calendar row is sorted.
    """
    ship_package(observed.sparkSession)
    doubles = [T.StructField(c, T.DoubleType()) for c in columns]
    schema = T.StructType([observed.schema[KEY], T.StructField(DAY, T.DateType()), *doubles, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, (head, _, series) in zip(batch.column(KEY).to_pylist(), _stations(batch, columns)):
                _, n, first, _ = head
                for at in range(skipped, n or 0, BATCH_DAYS):
                    to = min(at + BATCH_DAYS, n)
                    days = pa.array(np.arange(first + at, first + to, dtype=np.int32)).cast(pa.date32())
                    plain = [pa.array(x[at:to]) for x in series]
                    rows = [pa.array([key] * (to - at), pa.int64()), days, *plain, *made(series, at, to)]
                    yield pa.RecordBatch.from_arrays(rows, schema.names)

    return observed.select(KEY, _DAYS, *columns).mapInArrow(run, schema)


def is_observed(df: DataFrame) -> bool:
    """Whether ``df`` is an ``observed_pack``."""
    return _DAYS in df.columns


def lagged_days(observed: DataFrame, columns: Sequence[str], maxlags: int) -> DataFrame:
    """Completed days with ``{column}_lag{i}``: each lag is a slice of its series, from before its first day on."""
    columns = list(columns)

    def made(series, at: int, to: int) -> list[pa.Array]:
        out = []
        for x in series:
            # Days up to ``to``, and as many nulls before them as there are lags.
            first = max(at - maxlags, 0)
            before = pa.nulls(max(maxlags - at, 0), pa.float64())
            known = pa.concat_arrays([before, pa.array(x[first:to])])
            out += [known.slice(maxlags - i, to - at) for i in range(1, maxlags + 1)]
        return out

    lags = [T.StructField(f"{c}_lag{i}", T.DoubleType()) for c in columns for i in range(1, maxlags + 1)]
    return _day_rows(observed, columns, lags, made, 0)


def preceded_days(observed: DataFrame, columns: Sequence[str], length: int) -> DataFrame:
    """Completed days with the ``length`` days before them as ``sequence``; earlier days drop out."""
    columns = list(columns)

    def made(series, at: int, to: int) -> list[pa.Array]:
        windows = [np.lib.stride_tricks.sliding_window_view(x[at - length : to - 1], length) for x in series]
        structs = pa.StructArray.from_arrays([pa.array(w.ravel()) for w in windows], columns)
        return [pa.ListArray.from_arrays(pa.array(np.arange(to - at + 1, dtype=np.int32) * length), structs)]

    day = T.StructType([T.StructField(c, T.DoubleType()) for c in columns])
    return _day_rows(observed, columns, [T.StructField("sequence", T.ArrayType(day))], made, length)


def scaled_pack(observed: DataFrame, columns, test_size: int, keep: Sequence[str] = ()) -> DataFrame:
    """Training arrays of each station, their scalers and counts (see ``training_pack``)."""
    pack = completed(observed, columns, test_size, keep, scaled=True)
    return pack.select(
        KEY, *keep, "n_rows", "n", "last_day", scales_of_arrays(columns, None, "_centers", "_widths").alias("scales"),
        scales_of_arrays(columns, "minmax", "_lows", "_spans").alias("ranges"), *columns,
    )


def is_spread(pack: DataFrame) -> bool:
    """Whether ``pack`` is a ``spread_pack``."""
    return hasattr(pack, "_spread")


#: Column types of the rows that ``map_spread`` takes back from a task.
_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "array<double>": pa.list_(pa.float64()),
}


def map_spread(
    pack: DataFrame, columns: Sequence[str], scales: str | None,
    run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str,
) -> DataFrame:
    """Rows that ``run`` makes of a ``spread_pack``, in the task that completes its stations.

    The frames ``run`` gets hold a station, ``n``, the series of ``columns`` and, as
    ``centers`` and ``widths``, their ``scales`` or ``ranges`` (neutral ones, if None).
    Only observed days enter the task and only rows of ``schema`` leave it: a completed
    series goes neither to the JVM nor to a second Python worker.
    """
    ship_package(pack.sparkSession)
    observed, tasks, config = pack._spread
    variables, test_size = list(config.variables), config.test_size
    columns = list(columns)
    at = [variables.index(c) for c in columns]
    kinds = ["minmax" if scales == "ranges" else SCALER_KINDS.get(c, "standard") for c in columns]
    made = pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, schema.split(", "))])

    def scalers(series: list[np.ndarray]) -> np.ndarray:
        if scales is None:
            return np.array([(0.0, 1.0)] * len(columns)).T
        if not len(series[0]):
            return np.full((2, len(columns)), np.nan)
        return np.array([scaler_of(x, kind) for x, kind in zip(series, kinds)]).T

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            found = _stations(whole, variables, test_size)
            for begin in range(0, whole.num_rows, BATCH_STATIONS):
                keys = whole.column(KEY).slice(begin, BATCH_STATIONS).to_pylist()
                heads, _, series = zip(*islice(found, len(keys)))
                series = [[np.empty(0) if s is None else s[i] for i in at] for s in series]
                both = [scalers(s) for s in series]
                yield pd.DataFrame({
                    KEY: keys,
                    "n": [head[1] or 0 for head in heads],
                    **{c: [s[j] for s in series] for j, c in enumerate(columns)},
                    "centers": [centers for centers, _ in both],
                    "widths": [widths for _, widths in both],
                })

    def in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in run(frames(batches)):
            yield pa.RecordBatch.from_pandas(rows, made, preserve_index=False)

    return observed.select(KEY, _DAYS, *variables).repartition(tasks, KEY).mapInArrow(in_task, schema)


def series_pack(df: DataFrame, columns) -> DataFrame:
    """Completed series of each station; its observed days are written, counted and kept for joins."""
    observed, stations = packed(df, columns)
    pack = completed(observed, columns).filter(F.col("n") > 0)
    pack = pack.select(KEY, "first_day", "last_day", "n", *columns)
    pack._observed = observed, stations
    return pack


def counted(history: DataFrame) -> int | None:
    """Stations of a ``series_pack``; None for other tables."""
    return getattr(history, "_observed", (None, None))[1]


def joined_by_station(rows: DataFrame, observed: DataFrame, tasks: int, how: str = "inner") -> DataFrame:
    """``rows`` with the observed days of their station, in ``tasks`` tasks.

    Both sides are spread before the join, which then needs no exchange of its
    own, and whose tasks adaptive execution does not put together by their bytes.
    """
    return rows.repartition(tasks, KEY).join(observed.repartition(tasks, KEY), KEY, how)


def with_history(models: DataFrame, history: DataFrame, columns, last: str | None = None) -> DataFrame:
    """``models`` with last day and series of their station, spread over tasks of a bounded number of series.

    For a ``series_pack`` the observed days are joined and moved, and completed in
    the task; ``last`` names a column of ``models`` with the days that are needed.
    """
    observed = getattr(history, "_observed", (None, None))[0]
    tasks = task_count(models.sparkSession, (counted(history) or 0) * len(columns), SERIES_PER_TASK)
    if observed is None:
        joined = models.join(history.select(KEY, "last_day", *columns), KEY, "left").repartition(tasks, KEY)
        if last is None:
            return joined
        size = F.size(columns[0])
        kept = F.least(F.greatest(F.coalesce(last, F.lit(1)), F.lit(1)), size)
        return joined.withColumns({c: F.slice(c, size - kept + 1, kept) for c in columns})
    rest = [c for c in models.columns if c != KEY]
    joined = joined_by_station(models, observed.select(KEY, _DAYS, *columns), tasks, "left")
    return completed(joined, columns, keep=rest, last=last).select(KEY, *rest, "last_day", *columns)
