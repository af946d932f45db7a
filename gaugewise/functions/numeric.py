"""Null-safe arithmetic: a zero denominator or too few values give null, never an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def half_even(x: Column, decimals: int) -> Column:
    """Rounds to even on ties of the scaled value."""
    return F.rint(x * F.lit(10.0**decimals)) / F.lit(10.0**decimals)


def quantile(x: Column, p: float) -> Column:
    """Exact, linearly interpolated, nulls skipped."""
    return F.percentile(x, F.lit(float(p)))


def median(x: Column) -> Column:
    return quantile(x, 0.5)


def correlation(x: Column, y: Column) -> Column:
    """Pearson over rows where both are given; null for a constant side or fewer than two rows."""
    both = x.isNotNull() & y.isNotNull()
    return F.when(
        (F.var_pop(F.when(both, x)) > 0) & (F.var_pop(F.when(both, y)) > 0),
        ratio(F.covar_pop(x, y), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))),
    )


def day_number(ts: Column) -> Column:
    """Whole days since 1970-01-01."""
    return F.datediff(ts, F.lit("1970-01-01").cast("date"))


def days_between(later: Column, earlier: Column) -> Column:
    """Days as a double, fractions included."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere of radius 6371.0088 km."""
    a = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))) * (2 * 6371.0088)


def month_distance(a: Column, b: Column) -> Column:
    """Circular distance of two months, 0 to 6."""
    d = F.abs(a - b)
    return F.least(d, 12 - d)


def resampled(values: Column, points: int) -> Column:
    """An array read at ``points`` equal steps from its first to its last value, linearly interpolated."""
    last = F.size(values) - 1

    def at(i: Column) -> Column:
        place = i * last / F.lit(float(points - 1))
        low = F.least(F.floor(place).cast("int"), last)
        high = F.least(low + 1, last)
        a, b = F.get(values, low), F.get(values, high)
        return a + (b - a) * (place - low)

    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at))


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of one length; with a zero array 1 if both are zero, else 0."""
    zero = F.lit(0.0)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), zero, lambda s, v: s + v)

    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) & (nb == 0), 1.0).when((na == 0) | (nb == 0), 0.0).otherwise(ratio(dot(a, b), na * nb))
