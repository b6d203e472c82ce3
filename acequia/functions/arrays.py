"""Short arrays: ends of series, differences of them, feedback windows; JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def difference_once(series: Column, lag: int) -> Column:
    """x[t] - x[t-lag]; empty when the series is not longer than the lag."""
    rest = F.greatest(F.size(series) - lag, F.lit(0))
    return F.zip_with(
        F.slice(series, lag + 1, rest), F.slice(series, 1, rest), lambda now, then: now - then
    )


def difference(series: Column, d: int, seasonal_d: int, period: int) -> Column:
    """Seasonal differences first, then ordinary ones.

    Meant for the few values at the end of a series: each order evaluates its
    input twice. Whole series are differenced by windows or in Python tasks.
    """
    for _ in range(seasonal_d):
        series = difference_once(series, period)
    for _ in range(d):
        series = difference_once(series, 1)
    return series


def tail(series: Column, k: int) -> Column:
    """Last k items, or the whole array when shorter."""
    k_eff = F.least(F.lit(k), F.size(series))
    return F.slice(series, F.size(series) - k_eff + 1, k_eff)


def shift_append(window: Column, value: Column) -> Column:
    """Drop the oldest item and append a new one."""
    return F.concat(F.slice(window, 2, F.size(window) - 1), F.array(value))

