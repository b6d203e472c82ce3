"""Evapotranspiration, crop demand and irrigation need as column expressions.

Every function maps columns to a column, so the whole chain is one projection
inside whole-stage code generation and also runs on a streaming DataFrame.
Constants are double literals on purpose: decimal literals would change the
arithmetic type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from acequia.schema import DAY, CropParams

DEFAULT = CropParams()
NO_FORECAST = "no forecast rows to compute irrigation from"


def pressure_kpa(pressure_hpa: Column) -> Column:
    return pressure_hpa * F.lit(0.1)


def radiation_mj(rad_j: Column) -> Column:
    return rad_j / F.lit(1e6)


def saturation_vapour_pressure(temp_c: Column) -> Column:
    return F.lit(0.6108) * F.exp(F.lit(17.27) * temp_c / (temp_c + F.lit(237.3)))


def actual_vapour_pressure(es: Column, rh: Column) -> Column:
    return es * rh / F.lit(100.0)


def vapour_slope(es: Column, temp_c: Column) -> Column:
    shifted = temp_c + F.lit(237.3)
    return F.lit(4098.0) * es / (shifted * shifted)


def psychrometric(pressure: Column) -> Column:
    return F.lit(0.665e-3) * pressure


def net_radiation(rad_mj: Column) -> Column:
    """Short-wave balance with albedo 0.23; the daily soil heat flux is zero."""
    return F.lit(1.0 - 0.23) * rad_mj


def penman_monteith(slope, net_rad, gamma, temp_c, wind, es, ea) -> Column:
    """Daily reference evapotranspiration, mm/day (FAO-56 form)."""
    radiative = F.lit(0.408) * slope * net_rad
    aerodynamic = gamma * (F.lit(900.0) / (temp_c + F.lit(273.0))) * wind * (es - ea)
    return (radiative + aerodynamic) / (slope + gamma * (F.lit(1.0) + F.lit(0.34) * wind))


def et0_terms(
    temp: Column, rh: Column, wind: Column, pressure: Column, rad: Column
) -> dict[str, Column]:
    """All intermediate terms and ``et0`` for one day of weather."""
    p_kpa, rs = pressure_kpa(pressure), radiation_mj(rad)
    es = saturation_vapour_pressure(temp)
    ea = actual_vapour_pressure(es, rh)
    slope = vapour_slope(es, temp)
    gamma = psychrometric(p_kpa)
    rn = net_radiation(rs)
    return {
        "p_kpa": p_kpa,
        "rs_mj": rs,
        "es": es,
        "ea": ea,
        "slope": slope,
        "gamma": gamma,
        "rn": rn,
        "et0": penman_monteith(slope, rn, gamma, temp, wind, es, ea),
    }


def climate_et0_terms() -> dict[str, Column]:
    return et0_terms(
        F.col("temp_c"), F.col("rh"), F.col("wind_ms"), F.col("pressure_hpa"), F.col("rad_j")
    )


def _stage_ends(crop: CropParams) -> list[int]:
    ends, total = [], 0
    for days in crop.stage_days:
        total += days
        ends.append(total)
    return ends


def crop_coefficient(doy: Column, crop: CropParams = DEFAULT) -> Column:
    """Piecewise-linear Kc by day of year; the stages start on 1 January."""
    ini, dev, mid, late = _stage_ends(crop)
    rise = crop.kc_mid - crop.kc_initial
    fall = crop.kc_end - crop.kc_mid
    return (
        F.when(doy <= ini, F.lit(crop.kc_initial))
        .when(
            doy <= dev,
            F.lit(crop.kc_initial) + (doy - ini) / F.lit(float(crop.stage_days[1])) * F.lit(rise),
        )
        .when(doy <= mid, F.lit(crop.kc_mid))
        .when(
            doy <= late,
            F.lit(crop.kc_mid) + (doy - mid) / F.lit(float(crop.stage_days[3])) * F.lit(fall),
        )
        .when(doy.isNotNull(), F.lit(crop.kc_end))
    )


def deficit_factor(doy: Column, crop: CropParams = DEFAULT) -> Column:
    """Share of full crop demand supplied under the deficit strategy."""
    if crop.stage_deficit is None:
        return F.lit(crop.deficit)
    out = None
    for end, factor in zip(_stage_ends(crop), crop.stage_deficit):
        out = F.when(doy <= end, factor) if out is None else out.when(doy <= end, factor)
    return out.otherwise(crop.stage_deficit[-1])


def effective_rain(precip: Column, crop: CropParams = DEFAULT) -> Column:
    """Usable share of rain above the threshold; a missing reading counts as dry."""
    return F.when(
        precip > F.lit(crop.rain_threshold), precip * F.lit(crop.rain_fraction)
    ).otherwise(F.lit(0.0))


def net_need(demand: Column, rain: Column) -> Column:
    """max(0, demand - rain); a missing demand stays missing (``greatest`` would not)."""
    gap = demand - rain
    return F.when(gap < 0, F.lit(0.0)).otherwise(gap)


def gross_need(net: Column, crop: CropParams = DEFAULT) -> Column:
    return net / F.lit(crop.efficiency)


def with_irrigation(df: DataFrame, crop: CropParams = DEFAULT, day: str = DAY) -> DataFrame:
    """Add ET0, dia, ETc, Pe, NN, NB and their deficit counterparts to daily rows."""
    doy = F.col("dia")
    return (
        df.withColumns({"ET0": climate_et0_terms()["et0"], "dia": F.dayofyear(day)})
        .withColumns(
            {
                "ETc": crop_coefficient(doy, crop) * F.col("ET0"),
                "Pe": effective_rain(F.col("precip_mm"), crop),
            }
        )
        .withColumns(
            {
                "NN": net_need(F.col("ETc"), F.col("Pe")),
                "ETc_RDC": F.col("ETc") * deficit_factor(doy, crop),
            }
        )
        .withColumns(
            {
                "NB": gross_need(F.col("NN"), crop),
                "NN_RDC": net_need(F.col("ETc_RDC"), F.col("Pe")),
            }
        )
        .withColumn("NB_RDC", gross_need(F.col("NN_RDC"), crop))
    )


def calculate_irrigation(
    df: DataFrame, crop: CropParams = DEFAULT, observed: Observation | None = None
) -> DataFrame:
    """``with_irrigation`` for a finished forecast; an empty one is an error.

    Without ``observed`` emptiness is found by a job of its own, before anything
    is computed. With it the rows are counted as they are computed, and
    ``require_rows`` tells after they were written or collected.
    """
    if observed is not None:
        return with_irrigation(df.observe(observed, F.count(F.lit(1)).alias("rows")), crop)
    if df.isEmpty():
        raise ValueError(NO_FORECAST)
    return with_irrigation(df, crop)


def require_rows(observed: Observation) -> int:
    """Rows that were computed; none is an error. To be called after the action."""
    rows = observed.get["rows"]
    if not rows:
        raise ValueError(NO_FORECAST)
    return rows
