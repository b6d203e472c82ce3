"""SARIMA and SARIMAX over many stations: Spark prepares and spreads, tasks run the recursions.

Spark packs the series of a station and spreads the stations over all cores;
Python tasks fit, or run the recursion, for a batch of targets of one shape at
once, and return coefficients, or levels in natural units. The estimator
minimises the conditional sum of squares, so coefficients are close to, but
not the same as, exact maximum likelihood ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acequia.models import arma
from acequia.models.batches import BATCH, chunks, gathered, isolated, right_aligned
from acequia.models.family import NO_HISTORY, forecast_steps
from acequia.operators.packs import SERIES_PER_TASK, is_spread, map_spread, with_history
from acequia.operators.scaling import entry, scales_of_arrays
from acequia.operators.series import difference_weights
from acequia.schema import KEY, TrainConfig
from acequia.session import ship_package, task_count

FIT_SCHEMA = (
    "station bigint, target string, coef array<double>, sigma2 double, n bigint, error string, "
    "centers array<double>, widths array<double>, converged boolean, rounds int"
)
PATH_SCHEMA = (
    "station bigint, model string, target string, last_day date, path array<double>, error string"
)
#: Series fitted together: so many that the few which take long are seldom alone.
FIT_BATCH = 4 * BATCH
ORDER_FIELDS = ("p", "d", "q", "P", "D", "Q", "s")


def model_shape(order, seasonal, regressors: int = 0, const: bool | None = None) -> arma.Shape:
    """The seasonal family has a constant, the one with regressors has none."""
    p, _, q = order
    P, _, Q, s = seasonal
    return arma.Shape(p, q, P, Q, s, const=regressors == 0 if const is None else const, r=regressors)


def shortest_series(shape: arma.Shape, min_seasons: int = 0) -> int:
    """Differenced days a fit needs: more errors than parameters."""
    return max(shape.size + shape.p + shape.P * shape.s + 1, min_seasons * shape.s)


def scaler_arrays(variables) -> list[Column]:
    """Centers and scales of the variables, in their order."""
    return [
        F.array(*[entry(c)["center"] for c in variables]).alias("centers"),
        F.array(*[entry(c)["scale"] for c in variables]).alias("widths"),
    ]


def regressors_of(target: str, variables, chosen=None) -> list[str]:
    """The chosen variables, or all, but the target."""
    return [v for v in (chosen or variables) if v != target]


def _scaled(record, names, variables, centers, widths) -> list[np.ndarray]:
    """Scaled level series of one station: target first, then the regressors."""
    at = [variables.index(n) for n in names]
    return [
        (np.asarray(record[n], dtype=float) - centers[i]) / widths[i] for n, i in zip(names, at)
    ]


def differenced(series: np.ndarray, d: int, seasonal_d: int, period: int) -> np.ndarray:
    for _ in range(seasonal_d):
        series = series[period:] - series[:-period]
    return np.diff(series, d)


def _blocks(rows, d: int, seasonal_d: int, period: int):
    """Right-aligned differenced target block, regressor blocks or None, lengths."""
    # A station's series is the target of one row and a regressor of others.
    own = {id(x): x for row in rows for x in row}
    own = {i: differenced(x, d, seasonal_d, period) for i, x in own.items()}
    diffs = [[own[id(x)] for x in row] for row in rows]
    w, lengths = right_aligned([row[0] for row in diffs])
    if not np.isfinite(w).all():
        raise ValueError("series has gaps")
    count = len(diffs[0]) - 1
    x = [right_aligned([row[j + 1] for row in diffs])[0] for j in range(count)]
    return w, np.stack(x) if x else None, lengths


def _fit_tasks(config: TrainConfig, family: str, starts_only: bool = False):
    variables = list(config.variables)
    _, d, _ = config.order
    _, seasonal_d, _, period = config.seasonal
    lost_days = d + seasonal_d * period
    kept = ["station", "target", "centers", "widths"]

    def others(target: str) -> list[str]:
        return regressors_of(target, variables, config.regressors) if family == "sarimax" else []

    def emit(pdf: pd.DataFrame, coef, sigma2, n, error, converged, rounds=0) -> pd.DataFrame:
        out = pdf[kept].copy()
        out["coef"], out["sigma2"], out["n"], out["error"] = coef, sigma2, n, error
        out["converged"], out["rounds"] = converged, rounds
        return out[[
            "station", "target", "coef", "sigma2", "n", "error", "centers", "widths", "converged", "rounds"
        ]]

    def failed(pdf: pd.DataFrame, message: str) -> pd.DataFrame:
        return emit(pdf, None, np.nan, pdf["levels"].map(lambda x: len(x[0])), message, False)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stations in gathered(frames, max(FIT_BATCH // len(variables), 1)):
            rows = []
            for r in stations.to_dict("records"):
                scaled = dict(zip(variables, _scaled(r, variables, variables, r["centers"], r["widths"])))
                rows += [
                    (r["station"], target, r["centers"], r["widths"], [scaled[c] for c in (target, *others(target))])
                    for target in variables
                ]
            whole = pd.DataFrame(rows, columns=[*kept, "levels"])
            for count, pdf in whole.groupby(whole["levels"].map(len)):
                shape = model_shape(config.order, config.seasonal, count - 1, family == "sarima")
                needed = shortest_series(shape, config.min_seasons) + lost_days

                def work(pdf: pd.DataFrame, shape=shape) -> pd.DataFrame:
                    w, x, lengths = _blocks(pdf["levels"], d, seasonal_d, period)
                    starts = arma.start_values(shape, w, x, lengths)
                    if starts_only:
                        nothing = [None] * len(pdf)
                        return emit(pdf, list(starts.T), np.nan, lengths, nothing, False)
                    params, sigma2, used, converged, rounds = arma.fit(shape, w, x, lengths, starts)
                    error = np.where(np.isfinite(sigma2), None, "fit diverged")
                    return emit(pdf, list(params.T), sigma2, used, error, converged, rounds)

                short = pdf["levels"].map(lambda x: len(x[0])) < needed
                if short.any():
                    yield failed(pdf[short], f"series too short: at least {needed} days needed")
                if not short.all():
                    yield from isolated(pdf[~short].reset_index(drop=True), work, failed)

    return run


def _mapped(pack: DataFrame, config: TrainConfig, stations: int | None, run) -> DataFrame:
    """``run`` over packed series with their scalers, in tasks of a bounded number of series.

    A pack whose ``stations`` are known is spread already. That of ``spread_pack`` is
    completed in the same task.
    """
    variables = list(config.variables)
    if is_spread(pack):
        return map_spread(pack, variables, "scales", run, FIT_SCHEMA)
    spark = pack.sparkSession
    ship_package(spark)
    rows = pack.select(KEY, *variables, *scaler_arrays(variables))
    if stations is None:
        rows = rows.repartition(task_count(spark, pack.count() * len(variables), SERIES_PER_TASK), KEY)
    return rows.mapInPandas(run, FIT_SCHEMA)


def start_values(pack: DataFrame, config: TrainConfig, family: str, stations: int | None = None) -> DataFrame:
    """(station, target, start, error): what ``fit`` starts from, in the order of its parameters."""
    made = _mapped(pack, config, stations, _fit_tasks(config, family, starts_only=True))
    return made.select(KEY, "target", F.col("coef").alias("start"), "error")


def fit(
    pack: DataFrame, config: TrainConfig, family: str, stations: int | None = None
) -> DataFrame:
    """Fitted models (or error rows) for every station and variable of the pack.

    ``pack`` has one row per station: the training arrays and the ``scales``
    map; ``stations`` is its number of rows, where it is spread already. ``family``
    is 'sarima' or 'sarimax' (on ``config.regressors``). A task finds the start
    values of its series by two regressions and goes on from them; one exchange
    spreads the stations, scalers travel with the series. A fit whose error sum
    still fell in its last round is kept and says so under ``converged`` in
    ``params``.
    """
    variables = list(config.variables)
    fitted = _mapped(pack, config, stations, _fit_tasks(config, family))
    p, d, q = config.order
    P, D, Q, s = config.seasonal
    settings = dict(zip(ORDER_FIELDS, (p, d, q, P, D, Q, s)))
    settings["variables"] = ",".join(variables)
    if family == "sarimax":
        settings["regressors"] = ",".join(config.regressors or variables)
    known = [F.lit(str(x)) for kv in settings.items() for x in kv]
    told = [x for c in ("converged", "rounds") for x in (F.lit(c), F.col(c).cast("string"))]
    params = F.create_map(*known, *told)
    return fitted.select(
        F.lit(family).alias("model_type"),
        F.concat(F.lit(f"{family}_"), "target").alias("name"),
        KEY,
        "target",
        params.alias("params"),
        "coef",
        "sigma2",
        "n",
        scales_of_arrays(variables).alias("scales"),
        "error",
        F.current_timestamp().alias("trained_at"),
    )


def _ahead(series: np.ndarray, horizon: int, policy: str) -> np.ndarray:
    """Regressor values for the forecast steps (see ``exog_future`` for the policies)."""
    if policy == "head" and len(series) >= horizon:
        return series[:horizon]
    return np.full(horizon, series[-1])


def _forecast_tasks(columns: list[str], horizon: int, policy: str):
    kept = ["station", "model", "target", "last_day"]

    def emit(pdf: pd.DataFrame, path, message) -> pd.DataFrame:
        out = pdf[kept].copy()
        out["path"], out["error"] = path, message
        return out

    def failed(pdf: pd.DataFrame, message: str) -> pd.DataFrame:
        return emit(pdf, None, message)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        p, d, q, P, D, Q, s, count, const = pdf["setting"].iloc[0]
        shape = model_shape((p, d, q), (P, D, Q, s), count, const)
        params = np.stack(list(pdf["coef"])).T
        w, x, lengths = _blocks(pdf["levels"], d, D, s)
        path = arma.forecast(shape, params, w, x, lengths, horizon)
        reach, n = d + D * s, len(pdf)
        betas = params[int(const) : shape.first].T
        tails, shifts = np.zeros((reach, n)), np.zeros((horizon, n))
        for i, (beta, levels) in enumerate(zip(betas, pdf["levels"])):
            last = np.stack([v[len(v) - reach :] for v in levels])
            tails[:, i] = last[0] - beta @ last[1:]
            if count:
                shifts[:, i] = beta @ np.array([_ahead(v, horizon, policy) for v in levels[1:]])
        levels = arma.integrated(path, tails, difference_weights(d, D, s)) + shifts
        levels = levels * pdf["width"].to_numpy(float) + pdf["center"].to_numpy(float)
        if not np.isfinite(levels).all():
            raise ValueError("forecast is not finite")
        return emit(pdf, list(levels.T), None)

    def task(record, model) -> tuple:
        """A model with its scaled series, or what is wrong with it."""
        head = (record["station"], model["model_type"], model["target"], record["last_day"])
        if model["error"] is not None or model["coef"] is None:
            return *head, f"not trained: {model['error']}", None, None, None, None, None
        if record["last_day"] is None:
            return *head, NO_HISTORY, None, None, None, None, None
        target, sarimax = model["target"], model["model_type"] == "sarimax"
        chosen = model["regressors"] or model["variables"]
        names = [target, *(regressors_of(target, chosen.split(",")) if sarimax else [])]
        unknown = [c for c in names if c not in columns]
        if unknown:
            return *head, f"history lacks {unknown}", None, None, None, None, None
        at = columns.index(target)
        centers, widths = model["centers"], model["widths"]
        levels = _scaled(record, names, columns, centers, widths)
        setting = (*[int(model[f"order_{f}"]) for f in ORDER_FIELDS], len(names) - 1, not sarimax)
        return *head, None, setting, centers[at], widths[at], model["coef"], levels

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for stations in chunks(frames, max(BATCH // len(columns), 1)):
            rows = [
                task(record, model)
                for record in stations.where(stations.notna(), None).to_dict("records")
                for model in record["models"]
            ]
            names = [*kept, "error", "setting", "center", "width", "coef", "levels"]
            pdf = pd.DataFrame(rows, columns=names)
            lost = pdf["error"].notna()
            if lost.any():
                yield emit(pdf[lost], None, pdf.loc[lost, "error"])
            for _, same in pdf[~lost].groupby("setting"):
                yield from isolated(same.reset_index(drop=True), work, failed)

    return run


def forecast(models: DataFrame, history: DataFrame, horizon: int, policy: str = "hold") -> DataFrame:
    """Forecast rows (station, model, target, last_day, step, value, error) in natural units.

    ``models`` are registry rows of both seasonal families and of any orders;
    ``history`` is a pack whose last day the forecast starts after. A station's
    models travel together with its series; orders are grouped inside the task.
    A model that cannot be run gives one row with its error.
    """
    spark = models.sparkSession
    ship_package(spark)
    if policy not in ("hold", "head"):
        raise ValueError(f"unknown exog policy {policy!r}")
    columns = series_columns(history)
    params = F.col("params")
    model = F.struct(
        "model_type", "target", "coef", "error",
        *[params[f].alias(f"order_{f}") for f in ORDER_FIELDS],
        params["variables"].alias("variables"), params["regressors"].alias("regressors"),
        *scaler_arrays(columns),
    )
    by_station = models.groupBy(KEY).agg(F.collect_list(model).alias("models"))
    ready = with_history(by_station, history, columns)
    return forecast_steps(ready.mapInPandas(_forecast_tasks(columns, horizon, policy), PATH_SCHEMA))


def series_columns(history: DataFrame) -> list[str]:
    """The variables of a pack: its array columns."""
    return [c for c, kind in history.dtypes if kind == "array<double>"]
