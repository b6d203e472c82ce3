"""Vector autoregression and the windowed forecaster, from cross-products.

A station's packed series gives its cross-product matrix in one pass, without a
design matrix: one product for each lag difference, corrected at the ends.
Order choice, for all orders from one factorisation, refit and solution follow
from that matrix in the same task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from acequia.models import linear
from acequia.models.batches import chunks, isolated
from acequia.models.family import NO_HISTORY, forecast_steps
from acequia.models.sarima import series_columns
from acequia.operators.packs import is_spread, map_spread, with_history
from acequia.operators.scaling import entry, scales_of_arrays
from acequia.schema import KEY, TrainConfig
from acequia.session import ship_package, task_count

#: Days multiplied at once; longer than any series of daily rows on record.
BLOCK_DAYS = 1 << 17
#: Stations for one task.
STATIONS_PER_TASK = 256
MOMENT_SCHEMA = "station bigint, n bigint, gram array<double>, head array<double>"
SOLVE_SCHEMA = (
    "station bigint, p int, coef array<double>, sigma2 double, n bigint, "
    "criteria array<double>, error string, centers array<double>, widths array<double>"
)
PATH_SCHEMA = (
    "station bigint, model string, target string, last_day date, path array<double>, error string"
)


def _scalers(columns, scales: str | None) -> list[Column]:
    """Centers and scales of the variables as two arrays; neutral without ``scales``."""
    if scales is None:
        return [
            F.array(*[F.lit(0.0) for _ in columns]).alias("centers"),
            F.array(*[F.lit(1.0) for _ in columns]).alias("widths"),
        ]
    return [
        F.array(*[entry(c, scales)["center"] for c in columns]).alias("centers"),
        F.array(*[entry(c, scales)["scale"] for c in columns]).alias("widths"),
    ]


def _scaled_block(row, columns) -> np.ndarray:
    """(days, variables) of one row's arrays."""
    block = np.column_stack([row[c] for c in columns]).astype(float)
    return (block - row["centers"]) / row["widths"]


def station_moments(block: np.ndarray, lags: int, days: int | None = None) -> np.ndarray:
    """Cross-products of a whole series, a block of ``days`` rows at a time."""
    days, total = days or BLOCK_DAYS, 0.0
    for at in range(0, len(block) - lags, days):
        total = total + linear.cross_products(block[at : at + days + lags], lags)
    return total


def _mapped(
    pack: DataFrame, columns, scales: str | None, stations: int | None, run, schema: str
) -> DataFrame:
    """``run`` over packed series with their scalers, in tasks of a bounded number of stations.

    A pack whose ``stations`` are known is spread already. That of ``spread_pack`` is
    completed in the same task.
    """
    if is_spread(pack):
        return map_spread(pack, columns, scales, run, schema)
    spark = pack.sparkSession
    ship_package(spark)
    rows = pack.select(KEY, "n", *columns, *_scalers(columns, scales))
    if stations is None:
        rows = rows.repartition(task_count(spark, pack.count(), STATIONS_PER_TASK), KEY)
    return rows.mapInPandas(run, schema)


def moments(
    pack: DataFrame, columns, lags: int, scales: str | None = "scales", stations: int | None = None
) -> DataFrame:
    """Cross-products (upper triangle) of each station longer than ``lags``, and its first days."""
    columns = list(columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(frames, 64):
            pdf = pdf[pdf["n"] > lags].reset_index(drop=True)
            if pdf.empty:
                continue
            grams, heads = [], []
            for row in pdf.to_dict("records"):
                block = _scaled_block(row, columns)
                grams.append(linear.upper(station_moments(block, lags)))
                heads.append(block[:lags].ravel())
            out = pdf[["station"]].copy()
            out["n"], out["gram"], out["head"] = pdf["n"] - lags, grams, heads
            yield out

    return _mapped(pack, columns, scales, stations, run, MOMENT_SCHEMA)


def gram_entries(moments: DataFrame, columns, lags: int) -> DataFrame:
    """Cross-products as (station, term_a, term_b, value) rows."""
    terms = ["const"] + [f"{c}_lag{i}" for i in range(lags + 1) for c in columns]
    rows, cols = np.triu_indices(len(terms))
    named = [(n, terms[i], terms[j]) for n, (i, j) in enumerate(zip(rows.tolist(), cols.tolist()))]
    # one row for each pair of terms, whatever the number of stations
    names = moments.sparkSession.createDataFrame(named, "pos int, term_a string, term_b string")
    entries = moments.select(KEY, F.posexplode("gram").alias("pos", "value"))
    return entries.join(F.broadcast(names), "pos").select(KEY, "term_a", "term_b", "value")


def _solve_tasks(
    columns: list[str], lags: int, ic: str | None, ridge: float, needed: int, waves: linear.Waves | None
):
    k = len(columns)
    names = ["station", "p", "coef", "sigma2", "n", "criteria", "error", "centers", "widths"]

    def failed(pdf: pd.DataFrame, message: str) -> pd.DataFrame:
        out = pdf[["station", "n", "centers", "widths"]].copy()
        out["p"], out["coef"], out["sigma2"], out["criteria"] = None, None, np.nan, None
        out["error"] = message
        return out[names]

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in pdf.to_dict("records"):
            block = _scaled_block(row, columns)
            gram = linear.wave_products(block, lags, waves) if waves else station_moments(block, lags)
            if not np.isfinite(gram).all():
                raise ValueError("series has gaps")
            n, table, p = len(block) - lags, None, lags
            if ic is not None:
                table = linear.criteria(gram, n, k, lags)
                scores = table[:, linear.CRITERIA.index(ic)]
                if not np.isfinite(scores).any():
                    raise ValueError("variables are collinear or the series is too short")
                p = int(np.argmin(scores))
                gram = linear.refit_gram(gram, block[:lags], k, lags, p)
                n += lags - p
            coef, errors = linear.regress(gram, k, p, ridge, waves.count if waves else 0)
            sigma2 = float(np.trace(errors)) / (k * n)
            criteria = None if table is None else table.ravel()
            out.append(
                (row["station"], p, coef.ravel(), sigma2, n, criteria, None, row["centers"], row["widths"])
            )
        return pd.DataFrame(out, columns=names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(frames):
            short = pdf["n"] < needed
            if short.any():
                yield failed(pdf[short], f"series too short: at least {needed} days needed")
            if not short.all():
                yield from isolated(pdf[~short].reset_index(drop=True), work, failed)

    return run


def solve(
    pack: DataFrame, columns, lags: int, ic: str | None, ridge: float = 0.0, scales: str = "scales",
    stations: int | None = None, waves: linear.Waves | None = None,
) -> DataFrame:
    """One row per station: order, coefficients, error variance, criteria table, scalers.

    With ``ic`` the order is chosen on the common sample and refitted on every
    row it can use; without it the order is ``lags``. From the packed series to
    the coefficients there is one exchange, which spreads the stations.
    """
    columns, k = list(columns), len(columns)
    # the penalty makes any sample solvable, ordinary least squares needs a full one
    needed = lags + 2 if ridge else lags + k * lags + 2
    tasks = _solve_tasks(columns, lags, ic, ridge, needed, waves)
    return _mapped(pack, columns, scales, stations, tasks, SOLVE_SCHEMA)


def fit_orders(pack: DataFrame, config: TrainConfig, stations: int | None = None) -> DataFrame:
    """VAR solutions with their criteria table (see ``lag_selection``)."""
    return solve(pack, config.variables, config.maxlags, config.ic, stations=stations)


def lag_selection(solutions: DataFrame) -> DataFrame:
    """(station, p, aic, bic, hqic, fpe, chosen) for every order tried."""
    width = len(linear.CRITERIA)
    rows = solutions.filter(F.col("criteria").isNotNull()).select(
        KEY,
        F.col("p").alias("_best"),
        F.explode(
            F.sequence(F.lit(0), (F.size("criteria") / width).cast("int") - 1)
        ).alias("p"),
        "criteria",
    )
    return rows.select(
        KEY,
        "p",
        *[
            F.element_at("criteria", F.col("p") * width + i + 1).alias(name)
            for i, name in enumerate(linear.CRITERIA)
        ],
        (F.col("p") == F.col("_best")).alias("chosen"),
    )


def fit(
    pack: DataFrame, config: TrainConfig, family: str = "var", stations: int | None = None
) -> DataFrame:
    """Registry rows: 'var' (order by criterion) or 'window' (fixed length, ridge).

    ``config.parameters["window"]`` may hold ``features``, the number of random
    Fourier features of the window besides its lags (0: a linear model), their
    ``width`` in units of the scaled window and a ``seed``.
    """
    waves = None
    if family == "var":
        solved, kind = fit_orders(pack, config, stations), None
    else:
        own = config.parameters.get("window", {})
        if int(own.get("features", 0)):
            # Scaled windows lie in a cube; half its diagonal is a middling distance.
            width = float(own.get("width", 0.5 * (config.window * len(config.variables)) ** 0.5))
            waves = linear.Waves(int(own["features"]), width, int(own.get("seed", 1)))
        solved = solve(
            pack, config.variables, config.window, None, config.ridge, "ranges", stations, waves
        )
        kind = "minmax"
    settings = F.create_map(
        F.lit("p"),
        F.col("p").cast("string"),
        F.lit("variables"),
        F.lit(",".join(config.variables)),
        *([F.lit(x) for n in _WAVES for x in (n, str(getattr(waves, n)))] if waves else []),
    )
    return solved.select(
        F.lit(family).alias("model_type"),
        F.lit(f"{family}_multivariate").alias("name"),
        KEY,
        F.lit("multivariate").alias("target"),
        settings.alias("params"),
        "coef",
        "sigma2",
        "n",
        scales_of_arrays(config.variables, kind).alias("scales"),
        "error",
        F.current_timestamp().alias("trained_at"),
    )


#: Settings of the features, as a model's parameters name them.
_WAVES = ("count", "width", "seed")


def _forecast_tasks(columns: list[str], horizon: int):
    kept = ["station", "model", "last_day"]

    def emit(pdf: pd.DataFrame, targets, paths, message) -> pd.DataFrame:
        out = pdf[kept].copy()
        out["target"], out["path"], out["error"] = targets, paths, message
        return out[["station", "model", "target", "last_day", "path", "error"]]

    def failed(pdf: pd.DataFrame, message: str) -> pd.DataFrame:
        return emit(pdf, "multivariate", None, message)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        names, p = pdf["names"].iloc[0], int(pdf["p"].iloc[0])
        k = len(names)
        at = [columns.index(c) for c in names]
        waves = pdf["waves"].iloc[0]
        waves = linear.Waves(int(waves[0]), float(waves[1]), int(waves[2])) if waves else None
        width = 1 + k * p + (waves.count if waves else 0)
        coef = np.stack([np.reshape(c, (width, k)) for c in pdf["coef"]])
        centers = np.stack(list(pdf["centers"]))[:, at].astype(float)
        widths = np.stack(list(pdf["widths"]))[:, at].astype(float)
        levels = []
        for row in pdf.to_dict("records"):
            block = np.column_stack([row[c] for c in names])
            levels.append(block[len(block) - p :])
        state = (np.stack(levels).astype(float) - centers[:, None]) / widths[:, None]
        path = linear.recurse(coef, state, horizon, waves) * widths[:, None] + centers[:, None]
        if not np.isfinite(path).all():
            raise ValueError("forecast is not finite")
        many = pdf.loc[pdf.index.repeat(k)].reset_index(drop=True)
        return emit(many, list(names) * len(pdf), list(path.transpose(0, 2, 1).reshape(-1, horizon)), None)

    def problem(row) -> str | None:
        if row["error"] is not None or row["coef"] is None:
            return f"not trained: {row['error']}"
        if row["last_day"] is None:
            return NO_HISTORY
        unknown = [c for c in row["names"] if c not in columns]
        if unknown:
            return f"history lacks {unknown}"
        if len(row[row["names"][0]]) < row["p"]:
            return f"history shorter than {row['p']} days"
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks(frames, 512):
            pdf = pdf.astype(object).where(pdf.notna(), None)
            pdf["names"] = pdf["variables"].map(lambda v: tuple(v.split(",")))
            message = pdf.apply(problem, axis=1)
            lost = message.notna()
            if lost.any():
                yield emit(pdf[lost], "multivariate", None, message[lost])
            pdf["waves"] = [None if w is None else tuple(w.split(" ")) for w in pdf["waves"]]
            pdf["setting"] = list(zip(pdf["names"], pdf["p"], pdf["waves"]))
            for _, same in pdf[~lost].groupby("setting"):
                yield from isolated(same.reset_index(drop=True), work, failed)

    return run


def forecast(models: DataFrame, history: DataFrame, horizon: int) -> DataFrame:
    """Forecast rows (station, model, target, last_day, step, value, error) in natural units.

    ``models`` are registry rows of both multivariate families and of any
    order. Only the last days that a model's order asks for travel to the
    recursion. A model that cannot be run gives one row with its error.
    """
    spark = models.sparkSession
    ship_package(spark)
    columns = series_columns(history)
    p = F.col("params")["p"].cast("int")
    known = models.select(
        KEY, F.col("model_type").alias("model"), p.alias("p"),
        F.col("params")["variables"].alias("variables"),
        F.when(F.col("params")["count"].isNotNull(), F.concat_ws(" ", *[F.col("params")[n] for n in _WAVES])).alias("waves"),
        "coef", "error", *_scalers(columns, "scales"),
    )
    state = with_history(known, history, columns, last="p")
    return forecast_steps(state.mapInPandas(_forecast_tasks(columns, horizon), PATH_SCHEMA))
