"""Mergeable moments (count, mean, sum of squared deviations) and z-scores as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Moments = tuple[Column, Column, Column]


def moments(x: Column) -> Moments:
    """Aggregates over the non-null values of a column.

    A constant column gets its value as mean and exactly 0 as deviation, which
    averaging in floating point would not give.
    """
    n = F.count(x)
    constant = F.min(x) == F.max(x)
    mean = F.when(n == 0, 0.0).when(constant, F.min(x)).otherwise(F.avg(x))
    m2 = F.when((n < 2) | constant, 0.0).otherwise(F.var_pop(x) * n)
    return n, mean, m2


def merge_moments(a: Moments, b: Moments) -> Moments:
    """Moments of two disjoint sets from the moments of each; a null count is an empty set."""
    zero = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    n1, n2 = zero(a[0]), zero(b[0])
    m1, m2 = zero(a[1]), zero(b[1])
    n, d = n1 + n2, m2 - m1
    mean = F.when(n == 0, 0.0).when(n1 == 0, m2).when((n2 == 0) | (d == 0), m1).otherwise(m1 + d * n2 / n)
    return n.cast("long"), mean, zero(a[2]) + zero(b[2]) + F.when((n1 == 0) | (n2 == 0), 0.0).otherwise(d * d * n1 * n2 / n)


def deviation(count: Column, m2: Column) -> Column:
    """Sample standard deviation, 0 below two values."""
    return F.when(count < 2, 0.0).otherwise(F.sqrt(m2 / (count - 1)))


def z_score(x: Column, count: Column, mean: Column, m2: Column) -> Column:
    """Null where the history has no spread."""
    sd = deviation(count, m2)
    return F.when(sd != 0, (x - mean) / sd)
