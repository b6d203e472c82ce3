"""Calendar grid and time interpolation of daily station series.

A series has at most one row per calendar day; a second row for a day raises.
That bounds every station's window by its calendar span whatever the size of
the raw table. Each operator needs one exchange by station and one sort.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acequia.schema import DAY, KEY, VARIABLES

_OBS = "_obs_day"


def nan_to_null(df: DataFrame, columns=VARIABLES) -> DataFrame:
    """NaN compares greater than any number in Spark, so it must not pass ingest."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns if c in df.columns})


def _last_day_before_next() -> Column:
    """Last calendar day this observation is responsible for."""
    window = Window.partitionBy(KEY).orderBy(DAY)
    following = F.lead(DAY).over(window)
    problem = F.concat_ws(" ", F.lit("duplicate day"), F.col(DAY).cast("string"),
                          F.lit("for station"), F.col(KEY).cast("string"))
    return (
        F.when(following.isNull(), F.col(DAY))
        .when(following == F.col(DAY), F.raise_error(problem).cast("date"))
        .otherwise(F.date_sub(following, 1))
    )


def calendar_grid(df: DataFrame, columns=VARIABLES) -> DataFrame:
    """One row for every day from a station's first to its last; gaps are null rows.

    Each observation emits its own day and the empty days up to the next
    observation, so the grid needs no join and no min/max pass.
    """
    spans = df.filter(F.col(DAY).isNotNull()).select(
        KEY, F.col(DAY).alias(_OBS), *columns, _last_day_before_next().alias("_until")
    )
    return spans.select(
        KEY, F.explode(F.sequence(_OBS, "_until")).alias(DAY), _OBS, *columns
    ).select(KEY, DAY, *[F.when(F.col(DAY) == F.col(_OBS), F.col(c)).alias(c) for c in columns])


def duplicate_days(df: DataFrame) -> DataFrame:
    """Station days that occur more than once (``calendar_grid`` rejects them)."""
    return (
        df.groupBy(KEY, DAY).agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    )


def _with_neighbours(df: DataFrame, columns) -> DataFrame:
    """Add the latest known reading up to each row and the next known one after it.

    ``lead ... ignore nulls`` walks forward once; a frame running to the end
    of the partition would be recomputed for every row. Each reading is paired
    with its day before the exchange, so it travels once.
    """
    known = {
        f"_k_{c}": F.when(
            F.col(c).isNotNull(), F.struct(F.col(DAY).alias("d"), F.col(c).alias("v"))
        )
        for c in columns
    }
    up_to_row = Window.partitionBy(KEY).orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)
    neighbours = {}
    for c in columns:
        neighbours[f"_p_{c}"] = F.last(f"_k_{c}", ignorenulls=True).over(up_to_row)
        neighbours[f"_n_{c}"] = F.expr(
            f"lead(`_k_{c}`) ignore nulls over (partition by `{KEY}` order by `{DAY}`)"
        )
    return df.withColumns(known).withColumns(neighbours)


def _linear(c: str) -> Column:
    """Straight line between the neighbours; the last reading is held at the end."""
    before, after = F.col(f"_p_{c}"), F.col(f"_n_{c}")
    slope = (after["v"] - before["v"]) / F.datediff(after["d"], before["d"])
    return F.when(
        after.isNull() | (before["d"] == F.col(DAY)), before["v"]
    ).otherwise(before["v"] + slope * F.datediff(F.col(DAY), before["d"]))


def interpolate_time(df: DataFrame, columns=VARIABLES) -> DataFrame:
    """Fill nulls linearly in time, per station and column.

    Leading nulls stay null and trailing ones take the last reading.
    """
    kept = [c for c in df.columns if c not in columns]
    return _with_neighbours(df, columns).select(
        *kept, *[_linear(c).alias(c) for c in columns]
    )


def complete_series(df: DataFrame, columns=VARIABLES, flag: str | None = None) -> DataFrame:
    """``interpolate_time(calendar_grid(df))`` in one window over the observed rows.

    Neighbours are found before the empty days are generated, so only observed
    rows are exchanged and sorted. ``flag`` names an added column that tells
    whether a day has all variables; it is known before the days are generated.
    """
    observed = _with_neighbours(
        df.filter(F.col(DAY).isNotNull()).select(KEY, DAY, *columns), columns
    ).withColumn("_until", _last_day_before_next())
    carried = [f"_{side}_{c}" for c in columns for side in ("p", "n")]
    kept = [KEY]
    if flag:
        known = reduce(and_, [F.col(f"_p_{c}").isNotNull() for c in columns])
        observed, kept = observed.withColumn(flag, known), [KEY, flag]
    return observed.select(
        *kept, F.explode(F.sequence(DAY, "_until")).alias(DAY), *carried
    ).select(KEY, DAY, *kept[1:], *[_linear(c).alias(c) for c in columns])


def whole_series(df: DataFrame, columns=VARIABLES) -> DataFrame:
    """Completed series from each station's first day with all variables.

    Only leading days can lack a reading, so what remains has no gaps. The
    test is made on observed rows, before the calendar days are generated.
    """
    return complete_series(df, columns, "_whole").filter("_whole").drop("_whole")


def future_days(df: DataFrame, horizon: Column, last_day: str = "last_day") -> DataFrame:
    """Add one row per forecast step (1..horizon) with its calendar day."""
    return df.withColumn("step", F.explode(F.sequence(F.lit(1), horizon))).withColumn(
        DAY, F.date_add(F.col(last_day), F.col("step"))
    )
