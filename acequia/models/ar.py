"""First-order autoregression by built-in regression aggregates, no Python.

The special case of the seasonal model without moving-average terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acequia.operators.calendar import future_days
from acequia.operators.reports import unpivot_variables
from acequia.operators.series import integrate_forecast, seasonal_difference
from acequia.schema import DAY, KEY, VARIABLES


def differenced_pairs(
    df: DataFrame, columns=VARIABLES, d: int = 1, seasonal_d: int = 0, period: int = 30
) -> DataFrame:
    """Long rows (station, variable, day, level, w, w_before) of complete series."""
    marked = df.withColumn("_levels", F.struct(*columns))
    diffs = seasonal_difference(marked, columns, d, seasonal_d, period)
    before = Window.partitionBy(KEY).orderBy(DAY)
    rows = diffs.withColumn("_before", F.lag(F.struct(*columns)).over(before))
    entry = [
        F.struct(
            F.lit(c).alias("variable"),
            F.col(f"_levels.{c}").alias("level"),
            F.col(c).alias("w"),
            F.col(f"_before.{c}").alias("w_before"),
        )
        for c in columns
    ]
    return rows.select(KEY, DAY, F.explode(F.array(*entry)).alias("_e")).select(
        KEY, "_e.variable", DAY, "_e.level", "_e.w", "_e.w_before"
    )


def fit(pairs: DataFrame) -> DataFrame:
    """phi and intercept of w on its previous value; where forecasts start from.

    Sums are combined before the exchange; a series without variation has phi 0.
    """
    return pairs.groupBy(KEY, "variable").agg(
        F.coalesce(F.regr_slope("w", "w_before"), F.lit(0.0)).alias("phi"),
        F.coalesce(
            F.regr_intercept("w", "w_before"),
            F.avg(F.when(F.col("w_before").isNotNull(), F.col("w"))),
        ).alias("intercept"),
        F.regr_count("w", "w_before").alias("n"),
        F.max_by("w", DAY).alias("last_w"),
        F.max_by("level", DAY).alias("last_level"),
        F.max(DAY).alias("last_day"),
    )


def forecast(models: DataFrame, horizon: int) -> DataFrame:
    """Closed-form path mu + phi^h (w_T - mu), summed back to levels (d = 1).

    At phi = 1 there is no mean to return to: the differences grow by the intercept.
    """
    mean = F.col("intercept") / (F.lit(1.0) - F.col("phi"))
    path = F.when(
        F.col("phi") == 1.0, F.col("last_w") + F.col("intercept") * F.col("step")
    ).otherwise(mean + F.pow("phi", F.col("step")) * (F.col("last_w") - mean))
    steps = future_days(models, F.lit(horizon)).withColumns(
        {
            "value": path,
            "tail": F.array("last_level"),
        }
    )
    return integrate_forecast(
        steps, [KEY, "variable"], "value", "tail", d=1, seasonal_d=0, period=1
    ).select(KEY, "variable", DAY, "step", "value")


def simple_regression(df: DataFrame, target: str, columns, d: int = 1) -> DataFrame:
    """Differenced target on one differenced regressor at a time: slope, intercept, n."""
    diffs = seasonal_difference(df, [target, *columns], d, 0, 1)
    rows = unpivot_variables(diffs, columns, (KEY, DAY, target), "regressor")
    return rows.groupBy(KEY, "regressor").agg(
        F.regr_slope(target, "value").alias("slope"),
        F.regr_intercept(target, "value").alias("intercept"),
        F.regr_count(target, "value").alias("n"),
    )
