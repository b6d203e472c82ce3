"""Scaler parameters per station and variable, and applying or undoing them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acequia.schema import KEY, SCALER_KINDS, VARIABLES
from acequia.session import ship_package


def _nonzero(scale: Column) -> Column:
    """A constant column scales by one, not by zero."""
    return F.when(scale == 0, F.lit(1.0)).otherwise(scale)


def standard_params(c: str) -> tuple[Column, Column]:
    return F.avg(c), _nonzero(F.stddev_pop(c))


def quartiles(c: str) -> Column:
    """Exact quartiles by linear interpolation, in one aggregate."""
    return F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def robust_params(c: str) -> tuple[Column, Column]:
    q = quartiles(c)
    return q[1], _nonzero(q[2] - q[0])


def minmax_params(c: str) -> tuple[Column, Column]:
    return F.min(c), _nonzero(F.max(c) - F.min(c))


PARAMS = {"standard": standard_params, "robust": robust_params, "minmax": minmax_params}


def _percentile(ordered: np.ndarray, share: float) -> float:
    """Exact percentile by linear interpolation, as Spark's ``percentile`` weighs it."""
    place = (len(ordered) - 1) * share
    low, high = int(np.floor(place)), int(np.ceil(place))
    if low == high or ordered[low] == ordered[high]:
        return ordered[low]
    return (high - place) * ordered[low] + (place - low) * ordered[high]


def scaler_of(x: np.ndarray, kind: str) -> tuple[float, float]:
    """Center and scale of a series, as ``scaling.PARAMS`` define them."""
    low, high = np.fmin.reduce(x), x.max()
    if kind == "minmax":
        center, scale = low, high - low
    elif kind == "robust":
        ordered = np.sort(x)
        center = _percentile(ordered, 0.5)
        scale = _percentile(ordered, 0.75) - _percentile(ordered, 0.25)
    else:
        center, scale = x.mean(), 0.0 if low == high else x.std()
    return center, 1.0 if scale == 0 else scale


def scales_map(columns=VARIABLES, kind: str | None = None) -> Column:
    """Aggregate: map of variable -> (kind, center, scale).

    Without ``kind`` each variable takes the scaler its heading is routed to.
    """
    entries = []
    for c in columns:
        chosen = kind or SCALER_KINDS.get(c, "standard")
        center, scale = PARAMS[chosen](c)
        entries += [
            F.lit(c),
            F.struct(
                F.lit(chosen).alias("kind"), center.alias("center"), scale.alias("scale")
            ),
        ]
    return F.create_map(*entries)


def fit_scales(df: DataFrame, columns=VARIABLES, kind: str | None = None) -> DataFrame:
    """One row per station with its ``scales`` map; aggregated map-side first."""
    return df.groupBy(KEY).agg(scales_map(columns, kind).alias("scales"))


def scale_rows(scales: DataFrame) -> DataFrame:
    """Long form: (station, variable, kind, center, scale)."""
    return scales.select(KEY, F.explode("scales").alias("variable", "_p")).select(
        KEY, "variable", "_p.kind", "_p.center", "_p.scale"
    )


def entry(variable, scales: str = "scales") -> Column:
    return F.col(scales)[variable]


def scales_of_arrays(
    variables, kind: str | None = None, centers: str = "centers", widths: str = "widths"
) -> Column:
    """The ``scales`` map again, from two arrays in the order of ``variables``."""
    entries = []
    for i, c in enumerate(variables):
        chosen = F.lit(kind or SCALER_KINDS.get(c, "standard")).alias("kind")
        center = F.col(centers)[i].alias("center")
        entries += [F.lit(c), F.struct(chosen, center, F.col(widths)[i].alias("scale"))]
    return F.create_map(*entries)


def fit_and_scale(
    df: DataFrame, columns=VARIABLES, kind: str | None = None, undo: bool = False
) -> DataFrame:
    """Rows scaled by the parameters of their own station, and back again with ``undo``.

    A station's rows go to a task together and are scaled there, so a series is
    read once and nothing is joined; its rows are bounded by its days. With
    ``undo`` the columns hold the readings scaled and scaled back.
    """
    ship_package(df.sparkSession)
    columns = list(columns)
    rest = [c for c in df.columns if c != KEY]
    chosen = {c: kind or SCALER_KINDS.get(c, "standard") for c in columns}
    if unknown := set(chosen.values()) - set(PARAMS):
        raise KeyError(*unknown)
    schema = T.StructType([
        df.schema[KEY], *[T.StructField(c, T.DoubleType()) if c in chosen else df.schema[c] for c in rest]
    ])

    def scaled(series: pa.ChunkedArray, kind: str) -> pa.ChunkedArray:
        known = series.drop_null().to_numpy()
        if not len(known):
            return series
        center, width = scaler_of(known, kind)
        out = pc.divide(pc.subtract(series, center), width)
        return pc.add(pc.multiply(out, width), center) if undo else out

    def station(rows: pa.Table) -> pa.Table:
        made = {c: scaled(rows[c].cast(pa.float64()), chosen[c]) if c in chosen else rows[c] for c in schema.names}
        return pa.table(made)

    return df.groupBy(KEY).applyInArrow(station, schema)


def apply_scales(df: DataFrame, scales: DataFrame, columns=VARIABLES) -> DataFrame:
    """(x - center) / scale for every column, parameters joined by station.

    No broadcast hint: the parameter table grows with the number of stations.
    """
    joined = df.join(scales.select(KEY, "scales"), KEY)
    return joined.withColumns(
        {c: (F.col(c) - entry(c)["center"]) / entry(c)["scale"] for c in columns}
    ).drop("scales")


def invert_scales(df: DataFrame, scales: DataFrame, columns=VARIABLES) -> DataFrame:
    joined = df.join(scales.select(KEY, "scales"), KEY)
    return joined.withColumns(
        {c: F.col(c) * entry(c)["scale"] + entry(c)["center"] for c in columns}
    ).drop("scales")
