"""Summaries, previews, chart tables and the unified forecast table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acequia.schema import DAY, KEY, VARIABLES

PANELS = ("temp_c", "rh", "precip_mm", "ETc")


def series_summary(df: DataFrame, columns=VARIABLES) -> DataFrame:
    """Rows, columns, date range and the first five column names per station."""
    return df.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.lit(len(columns)).cast("bigint").alias("n_columns"),
        F.date_format(F.min(DAY), "yyyy-MM-dd").alias("first_day"),
        F.date_format(F.max(DAY), "yyyy-MM-dd").alias("last_day"),
        F.lit(", ".join(columns[:5])).alias("columns"),
    )


def head_tail(df: DataFrame, k: int, keys=(KEY,)) -> DataFrame:
    """First and last k rows per key, tagged by ``part`` and ``pos``.

    Two rank filters rather than one pass: each becomes a top-k that prunes
    rows before the exchange.
    """
    parts = []
    for part, order in (("head", F.asc(DAY)), ("tail", F.desc(DAY))):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
        parts.append(
            df.withColumn("pos", rank).filter(F.col("pos") <= k).withColumn("part", F.lit(part))
        )
    return parts[0].unionByName(parts[1])


def as_record(columns) -> Column:
    """Row as JSON text, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def unpivot_variables(df: DataFrame, columns=VARIABLES, ids=(KEY, DAY), name="variable"):
    return df.unpivot(list(ids), list(columns), name, "value")


def chart_variables(df: DataFrame, ids=(KEY, DAY)) -> DataFrame:
    """(panel, value) rows of the four charted columns that exist, exact names."""
    panels = [c for c in PANELS if c in df.columns]
    return unpivot_variables(df, panels, ids, "panel")


def chart_irrigation(df: DataFrame, ids=(KEY, DAY)) -> DataFrame:
    return df.select(*ids, "NB")


def irrigation_totals(df: DataFrame, keys=(KEY,)) -> DataFrame:
    """Season totals: gross need, deficit gross need and its daily mean."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"),
        F.sum("NB").alias("total_nb"),
        F.sum("NB_RDC").alias("total_nb_rdc"),
        F.avg("NB_RDC").alias("mean_nb_rdc"),
    )


def unify_forecasts(
    forecasts: DataFrame, keys=("model", KEY, DAY), columns=VARIABLES
) -> DataFrame:
    """Long per-variable forecasts to one wide row per model, station and day.

    Keeps only days every variable has a forecast for, which is what joining
    the variables one by one on the day would keep, with one exchange. Two
    forecasts of one variable for the same keys are an error.
    """
    sums = []
    for c in columns:
        own = F.when(F.col("variable") == c, F.col("value"))
        sums += [F.max(own).alias(c), F.count(own).alias(f"_n_{c}")]
    grouped = forecasts.groupBy(*keys).agg(*sums)
    most = F.greatest(*[F.col(f"_n_{c}") for c in columns]) if len(columns) > 1 else F.col(f"_n_{columns[0]}")
    named = F.concat(F.lit("two forecasts of one variable for "), F.to_json(F.struct(*keys)))
    wide = grouped.withColumn(columns[0], F.when(most > 1, F.raise_error(named)).otherwise(F.col(columns[0])))
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    return wide.filter(complete).select(*keys, *columns)


def missing_variables(
    forecasts: DataFrame, keys=("model", KEY), columns=VARIABLES, reasons: str | None = None
) -> DataFrame:
    """Models that lack a forecast for some variable, and which ones.

    ``reasons`` names a column of messages; the distinct ones are listed as well.
    """
    present = F.collect_set(F.when(F.col("value").isNotNull(), F.col("variable")))
    every = F.array(*[F.lit(c) for c in columns])
    found = [F.array_except(every, present).alias("missing")]
    if reasons:
        found.append(F.array_sort(F.collect_set(reasons)).alias("reasons"))
    return forecasts.groupBy(*keys).agg(*found).filter(F.size("missing") > 0)
