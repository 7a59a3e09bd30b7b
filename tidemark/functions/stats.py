"""Statistics built from mergeable Spark aggregates (partial + final hash aggregate)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_null_count(x: Column) -> Column:
    """Non-null count; null rather than 0 for a group without values."""
    return F.nullif(F.count(x), F.lit(0))


def sample_skewness(x: Column) -> Column:
    """n/((n-1)(n-2)) * sum(z^3) with population z; null below three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, n * n / ((n - 1) * (n - 2)) * F.skewness(x))


def sample_kurtosis(x: Column) -> Column:
    """Bias-corrected excess kurtosis on population z; null below four values."""
    n = F.count(x).cast("double")
    z4 = n * (F.kurtosis(x) + 3)
    scale = n * (n + 1) / ((n - 1) * (n - 2) * (n - 3))
    shift = 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3))
    return F.when(n > 3, scale * z4 - shift)


def geometric_mean(x: Column, strict: bool = False) -> Column:
    bad = F.raise_error("geometric mean needs positive values") if strict else F.lit(None)
    return F.when(F.min(x) > 0, F.exp(F.avg(F.when(x > 0, F.ln(x))))).when(F.min(x) <= 0, bad.cast("double"))


def harmonic_mean(x: Column, strict: bool = False) -> Column:
    zero = F.max(F.when(x == 0, 1).otherwise(0)) == 1
    bad = F.raise_error("harmonic mean needs non-zero values") if strict else F.lit(None)
    return F.when(zero, bad.cast("double")).otherwise(F.count(x) / F.sum(F.when(x != 0, 1 / x)))


def root_mean_square(x: Column) -> Column:
    return F.sqrt(F.avg(x * x))


def coefficient_of_variation(x: Column) -> Column:
    return F.when(F.avg(x) != 0, F.stddev_pop(x) / F.avg(x) * 100)


def z_score(x: Column, value: float) -> Column:
    return F.when(F.stddev_pop(x) != 0, (F.lit(float(value)) - F.avg(x)) / F.stddev_pop(x))


def percentile_rank(x: Column, value: float) -> Column:
    """(below + half of equal) / n * 100."""
    v = F.lit(float(value))
    below, equal = F.count_if(x < v), F.count_if(x == v)
    return F.when(F.count(x) > 0, (below + 0.5 * equal) / F.count(x) * 100)
