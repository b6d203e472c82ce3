"""Model families: what a type of model offers, and the table of those known.

A ``Family`` is a pair of Spark jobs, from packed series to registry rows and
from registry rows and histories to forecast rows. Training asks for families
by name and forecasting finds them by the registry's ``model_type``, so a new
one needs only ``register``.

``series_family`` makes a family of a user's own model of one series: two plain
functions on NumPy arrays. Spark scales, packs, spreads and isolates the series;
the functions are sent to the Python workers with the job, by value, so they
may live in a notebook or a script.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acequia.models.batches import chunks, isolated
from acequia.operators.packs import SERIES_PER_TASK, is_spread, map_spread, with_history
from acequia.operators.scaling import entry, scales_of_arrays
from acequia.schema import DAY, KEY, TrainConfig
from acequia.session import ship_package, task_count

NO_HISTORY = "no history for this station"

Fit = Callable[[DataFrame, TrainConfig, int | None], DataFrame]
Forecast = Callable[[DataFrame, DataFrame, int, str], DataFrame]


@dataclass(frozen=True)
class Family:
    """A type of model.

    ``fit(pack, config, stations)`` gives registry rows from packed series (see
    ``training_pack``), ``stations`` being their number where they are spread over tasks already.
    ``forecast(models, history, horizon, policy)`` gives rows (station, model,
    target, last_day, step, value, error, day) in natural units, one row with an
    error for a model that cannot be run. Families that share a ``forecast``
    are forecast in one job.
    """

    name: str
    fit: Fit
    forecast: Forecast


_KNOWN: dict[str, Family] = {}


def register(family: Family, replace: bool = False) -> Family:
    """Make a family known under its name; a taken name is an error unless ``replace``."""
    if family.name in _KNOWN and not replace:
        raise ValueError(f"model family {family.name!r} is registered already")
    _KNOWN[family.name] = family
    return family


def unregister(name: str) -> None:
    _KNOWN.pop(name, None)


def known() -> tuple[str, ...]:
    return tuple(_KNOWN)


def family(name: str) -> Family:
    if name not in _KNOWN:
        raise ValueError(f"unknown model family {name!r}; known are {known()}")
    return _KNOWN[name]


def by_forecast(types) -> list[tuple[Forecast, list[str]]]:
    """Known ones of ``types``, grouped by the job that forecasts them."""
    jobs: dict[int, tuple[Forecast, list[str]]] = {}
    for name in sorted(set(types) & set(_KNOWN)):
        job = _KNOWN[name].forecast
        jobs.setdefault(id(job), (job, []))[1].append(name)
    return list(jobs.values())


def forecast_steps(paths: DataFrame) -> DataFrame:
    """One row per step of each path; a path that failed keeps one row with its error."""
    return paths.select(
        KEY, "model", "target", "last_day", "error", F.posexplode_outer("path").alias("pos", "value")
    ).select(
        KEY, "model", "target", "last_day", (F.col("pos") + 1).alias("step"), "value", "error",
        F.date_add("last_day", F.col("pos") + 1).alias(DAY),
    )


# --- a user's own model of one series --------------------------------------

SeriesFit = Callable[[np.ndarray, Mapping[str, str]], np.ndarray]
SeriesForecast = Callable[[np.ndarray, np.ndarray, int, Mapping[str, str]], np.ndarray]

_FIT_SCHEMA = (
    "station bigint, target string, coef array<double>, sigma2 double, n bigint, error string, "
    "centers array<double>, widths array<double>"
)
_PATH_SCHEMA = (
    "station bigint, model string, target string, last_day date, path array<double>, error string"
)


def _by_value(*functions) -> bytes:
    """Functions for the workers; those of modules outside this package travel as code."""
    package = __name__.partition(".")[0]
    homes = {f.__module__ for f in functions if f.__module__.partition(".")[0] != package}
    modules = [sys.modules[m] for m in homes if m in sys.modules and m != "__main__"]
    for module in modules:
        cloudpickle.register_pickle_by_value(module)
    try:
        return cloudpickle.dumps(functions)
    finally:
        for module in modules:
            cloudpickle.unregister_pickle_by_value(module)


def series_family(
    name: str,
    fit: SeriesFit,
    forecast: SeriesForecast,
    *,
    state_days: int | None = None,
    parameters: Mapping[str, object] | None = None,
    least_days: int = 1,
) -> Family:
    """A family of one model per station and variable, each on its own scaled series.

    ``fit(series, parameters)`` gives coefficients; ``forecast(coef, state,
    horizon, parameters)`` gives ``horizon`` values after ``state``, the series'
    last ``state_days`` days (all, if None: the shape of the state). Parameters
    are saved with each model as text, and forecasts read the saved ones;
    ``config.parameters[name]`` overrides those given here. A series shorter
    than ``least_days``, one that ``fit`` or ``forecast`` raises on, and results
    that are not finite become error rows of that series alone.
    """
    code = _by_value(fit, forecast)
    defaults = {k: str(v) for k, v in (parameters or {}).items()}

    def fit_job(pack: DataFrame, config: TrainConfig, stations: int | None = None) -> DataFrame:
        spark = pack.sparkSession
        ship_package(spark)
        variables = list(config.variables)
        own = defaults | {k: str(v) for k, v in config.parameters.get(name, {}).items()}

        def failed(pdf: pd.DataFrame, message: str) -> pd.DataFrame:
            return pdf[["station", "target", "centers", "widths", "n"]].assign(
                coef=None, sigma2=np.nan, error=message
            )[_names(_FIT_SCHEMA)]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            make, _ = cloudpickle.loads(code)

            def work(pdf: pd.DataFrame) -> pd.DataFrame:
                coefs = []
                for series in pdf["series"]:
                    if len(series) < least_days:
                        raise ValueError(f"series too short: at least {least_days} days needed")
                    coef = np.asarray(make(series, own), dtype=float).ravel()
                    if not np.isfinite(coef).all():
                        raise ValueError("fit diverged")
                    coefs.append(coef)
                return pdf.assign(coef=coefs, sigma2=np.nan, error=None)[_names(_FIT_SCHEMA)]

            for stations_ in chunks(frames):
                rows = [
                    (r["station"], v, r["centers"], r["widths"], len(r[v]),
                     (np.asarray(r[v], float) - r["centers"][i]) / r["widths"][i])
                    for r in stations_.to_dict("records")
                    for i, v in enumerate(variables)
                ]
                names = ["station", "target", "centers", "widths", "n", "series"]
                yield from isolated(pd.DataFrame(rows, columns=names), work, failed)

        centers = F.array(*[entry(c)["center"] for c in variables]).alias("centers")
        widths = F.array(*[entry(c)["scale"] for c in variables]).alias("widths")
        if is_spread(pack):
            fitted = map_spread(pack, variables, "scales", run, _FIT_SCHEMA)
        else:
            rows = pack.select(KEY, *variables, centers, widths)
            if stations is None:
                rows = rows.repartition(task_count(spark, pack.count() * len(variables), SERIES_PER_TASK), KEY)
            fitted = rows.mapInPandas(run, _FIT_SCHEMA)
        saved = own | {"variables": ",".join(variables)}
        return fitted.select(
            F.lit(name).alias("model_type"),
            F.concat(F.lit(f"{name}_"), "target").alias("name"),
            KEY,
            "target",
            F.create_map(*[F.lit(x) for kv in saved.items() for x in kv]).alias("params"),
            "coef",
            "sigma2",
            "n",
            scales_of_arrays(variables).alias("scales"),
            "error",
            F.current_timestamp().alias("trained_at"),
        )

    def forecast_job(models: DataFrame, history: DataFrame, horizon: int, policy: str = "hold") -> DataFrame:
        ship_package(models.sparkSession)
        columns = [c for c, kind in history.dtypes if kind == "array<double>"]
        whole = F.coalesce(*[F.when(F.col("target") == c, F.col(c)) for c in columns])
        kept = F.size("whole") if state_days is None else F.least(F.lit(state_days), F.size("whole"))
        scale = F.col("scales")[F.col("target")]
        model = F.struct(
            F.col("model_type").alias("model"), "target", "params", "coef", "error",
            scale["center"].alias("center"), scale["scale"].alias("width"),
        )
        # A station's models travel together, so that its series does so once.
        by_station = models.groupBy(KEY).agg(F.collect_list(model).alias("models"))
        ready = (
            with_history(by_station, history, columns)
            .select(KEY, "last_day", *columns, F.inline("models"))
            .select(
                KEY, "model", "target", "last_day", "params", "coef", "error", "center", "width", whole.alias("whole")
            )
            .withColumn("state", F.slice("whole", F.size("whole") - kept + 1, kept))
            .drop("whole")
        )

        def emit(pdf: pd.DataFrame, path, message) -> pd.DataFrame:
            out = pdf[["station", "model", "target", "last_day"]].copy()
            out["path"], out["error"] = path, message
            return out

        def failed(pdf: pd.DataFrame, message: str) -> pd.DataFrame:
            return emit(pdf, None, message)

        def problem(row) -> str | None:
            if row["error"] is not None or row["coef"] is None:
                return f"not trained: {row['error']}"
            if row["last_day"] is None:
                return NO_HISTORY
            return f"history lacks {[row['target']]}" if row["state"] is None else None

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            _, ahead = cloudpickle.loads(code)

            def work(pdf: pd.DataFrame) -> pd.DataFrame:
                paths = []
                for r in pdf.to_dict("records"):
                    state = (np.asarray(r["state"], float) - r["center"]) / r["width"]
                    path = np.asarray(ahead(np.asarray(r["coef"], float), state, horizon, dict(r["params"])), float)
                    if path.shape != (horizon,) or not np.isfinite(path).all():
                        raise ValueError("forecast is not finite or not of the horizon's length")
                    paths.append(path * r["width"] + r["center"])
                return emit(pdf, paths, None)

            for pdf in chunks(frames):
                pdf = pdf.astype(object).where(pdf.notna(), None)
                message = pdf.apply(problem, axis=1)
                lost = message.notna()
                if lost.any():
                    yield emit(pdf[lost], None, message[lost])
                if not lost.all():
                    yield from isolated(pdf[~lost].reset_index(drop=True), work, failed)

        return forecast_steps(ready.mapInPandas(run, _PATH_SCHEMA))

    return Family(name, fit_job, forecast_job)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]
