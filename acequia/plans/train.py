"""Train every chosen model family for every station."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from acequia.models import families  # noqa: F401 - registers the built-in ones
from acequia.models.family import family
from acequia.operators.packs import SERIES_PER_TASK, joined_by_station, observed_pack, packed, scaled_pack
from acequia.schema import KEY, TrainConfig
from acequia.session import task_count


def training_pack(df: DataFrame, config: TrainConfig) -> DataFrame:
    """One row per station: training arrays, their scalers, and the row counts.

    One exchange by station packs the observed days; calendar, interpolation,
    split and scalers follow in the same task (see ``acequia.operators.packs``).
    A station whose test part takes every row keeps a row here, with empty
    arrays, so that it ends as an error row and not as a silent loss.
    """
    observed = packed(df, config.variables)[0] if hasattr(df, "_packed") else observed_pack(df, config.variables)
    return scaled_pack(observed, config.variables, config.test_size)


def spread_pack(df: DataFrame, config: TrainConfig) -> tuple[DataFrame, int]:
    """``training_pack`` spread over tasks of a bounded number of series, and its stations.

    The observed days are written, counted on the way; each reader completes
    them after they are spread, so no completed series is exchanged or written.
    """
    observed, stations = packed(df, config.variables)
    tasks = task_count(df.sparkSession, stations * len(config.variables), SERIES_PER_TASK)
    pack = scaled_pack(observed.repartition(tasks, KEY), config.variables, config.test_size)
    pack._spread = observed, tasks, config
    return pack, stations


def beside_pack(pack: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows``, one a station, with that station's row of a ``spread_pack``.

    They are joined to the observed days, so that no completed series is exchanged.
    """
    observed, tasks, config = pack._spread
    rest = [c for c in rows.columns if c != KEY]
    joined = joined_by_station(rows, observed, tasks)
    return scaled_pack(joined, config.variables, config.test_size, rest)


def fit_family(
    pack: DataFrame, config: TrainConfig, name: str, stations: int | None = None
) -> DataFrame:
    """Registry rows of one family, found by its name (see ``acequia.models.family``)."""
    return family(name).fit(pack, config, stations)


def train_all(
    df: DataFrame, config: TrainConfig = TrainConfig(), observed: Observation | None = None
) -> DataFrame:
    """Registry rows for every (family, station, target), failures as error rows.

    The observed days are written once, counted on the way, and read by each
    family. ``observed`` collects ``models`` and ``failures`` while the rows are
    written or collected, without a job of its own.
    """
    pack, stations = spread_pack(df, config)
    parts = [fit_family(pack, config, name, stations) for name in config.families]
    models = reduce(DataFrame.unionByName, parts)
    if observed is None:
        return models
    return models.observe(
        observed, F.count(F.lit(1)).alias("models"), F.count("error").alias("failures")
    )
