"""Forecast with loaded models and turn the forecasts into irrigation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from acequia.functions.agronomy import DEFAULT, with_irrigation
from acequia.models import families  # noqa: F401 - registers the built-in ones
from acequia.models.family import by_forecast, known
from acequia.operators.packs import series_pack
from acequia.operators.reports import irrigation_totals, missing_variables, unify_forecasts
from acequia.schema import DAY, DEFAULT_HORIZON, KEY, MAX_HORIZON, VARIABLES, CropParams
from acequia.session import materialize, materialize_counted
from acequia.sources.export import export_results

RUN_KEYS = ("run_id", "model", KEY)


def horizon_days(requested: int = DEFAULT_HORIZON, max_horizon: int = MAX_HORIZON) -> int:
    """The requested horizon; more than ``max_horizon`` days, or none, is an error."""
    if not 1 <= requested <= max_horizon:
        raise ValueError(f"horizon must be 1 to {max_horizon} days, got {requested}")
    return requested


def history_pack(df: DataFrame, columns=VARIABLES) -> DataFrame:
    """Completed series of each station as arrays, from its first complete day on.

    The observed days are written at once; readers complete them.
    """
    return series_pack(df, columns)


def predict_all(
    models: DataFrame,
    history: DataFrame,
    horizon: int = DEFAULT_HORIZON,
    policy: str = "hold",
    run_id: str = "run",
    max_horizon: int = MAX_HORIZON,
    observed: Observation | None = None,
) -> DataFrame:
    """Forecast rows of every model: run_id, model, station, variable, day, step, value, error.

    ``models`` are registry rows, ``history`` is a ``history_pack``. Forecasts
    start the day after each station's last day and are in natural units. A
    model that failed in training, has no history or cannot be run yields one
    row with its error and no day. Models are written once, so a lazy training
    is not repeated; which types there are is observed on the way. A
    ``history_pack`` has its observed days written; each job completes them.
    Each type is run by its family's job (``acequia.models.family``), families
    that share one together; types without a family give error rows.
    ``observed`` collects ``rows`` and ``failures`` while the forecasts are
    written or collected, without a job of its own.
    """
    horizon = horizon_days(horizon, max_horizon)
    models, seen = materialize_counted(
        models, "models", types=F.collect_set("model_type"), trained=F.count("coef")
    )
    if not seen["trained"]:
        raise ValueError("no trained models of the chosen types")
    parts = [
        job(models.filter(F.col("model_type").isin(names)), history, horizon, policy)
        for job, names in by_forecast(seen["types"])
    ]
    other = models.filter(~F.coalesce(F.col("model_type").isin(*known()), F.lit(False)))
    unknown = other.select(
        KEY, F.col("model_type").alias("model"), "target", F.lit(None).cast("date").alias("last_day"),
        F.lit(None).cast("int").alias("step"), F.lit(None).cast("double").alias("value"),
        F.concat(F.lit("unknown model type "), F.coalesce("model_type", F.lit("null"))).alias("error"),
        F.lit(None).cast("date").alias(DAY),
    )
    out = reduce(DataFrame.unionByName, [*parts, unknown]).select(
        F.lit(run_id).alias("run_id"), "model", KEY, F.col("target").alias("variable"),
        DAY, "step", "value", "error",
    )
    if observed is None:
        return out
    return out.observe(observed, F.count(F.lit(1)).alias("rows"), F.count("error").alias("failures"))


def forecast_irrigation(
    models: DataFrame,
    history: DataFrame,
    horizon: int = DEFAULT_HORIZON,
    policy: str = "hold",
    run_id: str = "run",
    crop: CropParams = DEFAULT,
) -> DataFrame:
    """Daily irrigation per model and station from forecasts of all seven variables.

    A model and station that lack a variable give one row without a day whose
    ``error`` names the variables and what went wrong with them.
    """
    forecasts = materialize(predict_all(models, history, horizon, policy, run_id), "forecasts")
    wide = unify_forecasts(forecasts.filter(F.col("error").isNull()), (*RUN_KEYS, DAY))
    daily = with_irrigation(wide, crop).withColumn("error", F.lit(None).cast("string"))
    return daily.unionByName(incomplete(forecasts), allowMissingColumns=True)


def incomplete(forecasts: DataFrame) -> DataFrame:
    """One row per run, model and station without all variables, and why."""
    missing = missing_variables(forecasts, RUN_KEYS, reasons="error")
    return missing.select(
        *RUN_KEYS,
        F.concat_ws(
            "; ",
            F.concat(F.lit("no forecast of "), F.array_join("missing", ", ")),
            F.when(F.size("reasons") > 0, F.array_join("reasons", "; ")),
        ).alias("error"),
    )


def publish(results: DataFrame, path: str, fmt: str = "json") -> DataFrame:
    """Write the daily results per model and return season totals.

    A model and station without results keeps a row with its error.
    """
    export_results(results, path, fmt)
    totals = irrigation_totals(results.filter(F.col("error").isNull()), RUN_KEYS)
    lost = results.filter(F.col("error").isNotNull()).select(*RUN_KEYS, "error")
    return totals.unionByName(lost, allowMissingColumns=True)
