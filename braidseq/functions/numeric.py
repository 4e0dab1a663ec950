"""Vectors, matrices and normal densities as Column expressions (arrays of doubles)."""

from __future__ import annotations

from math import erfc, pi, sqrt

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Where the positive normal density is cut, and the least density taken for a Gaussian row.
CUT, FLOOR = -0.1, 1e-4


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def normalize(v: Column) -> Column:
    """v by its sum; null if that is not above 0."""
    return F.when(total(v) > 0, F.transform(v, lambda x: x / total(v)))


def constant(v: Column, c: float, keep_zeros: bool = False) -> Column:
    return F.transform(v, lambda x: F.when(F.lit(keep_zeros) & (x == 0), 0.0).otherwise(F.lit(c)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def times(matrix: Column, v: Column) -> Column:
    return F.transform(matrix, lambda row: dot(row, v))


def transpose(matrix: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(matrix, F.lit(0))) - 1), lambda j: F.transform(matrix, lambda row: F.get(row, j)))


def stochastic(matrix: Column, tolerance: float = 1e-8) -> Column:
    return F.forall(matrix, lambda row: F.abs(total(row) - 1) <= tolerance)


def normal_density(x: Column, mean: Column, variance: Column) -> Column:
    """Null where the variance is not above 0."""
    return F.when(variance > 0, F.exp(-(x - mean) * (x - mean) / (2 * variance)) / F.sqrt(2 * pi * variance))


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series, mean: pd.Series, variance: pd.Series) -> pd.Series:
    return pd.Series([0.5 * erfc((m - a) / sqrt(2 * u)) if u > 0 else None for a, m, u in zip(x, mean, variance)])


def truncated_density(x: Column, mean: Column, variance: Column, cut: float = CUT) -> Column:
    """Normal density on [cut, inf), scaled to 1."""
    return F.when(x < cut, 0.0).otherwise(normal_density(x, mean, variance) / (1 - normal_cdf(F.lit(cut), mean, variance)))


def log_sum(v: Column) -> Column:
    """log of the sum of exp; null entries are log 0; null if all are."""
    top = F.array_max(v)
    return top + F.log(F.aggregate(F.filter(v, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def emission_row(history: Column, symbol: Column, symbols: int, order: Column) -> Column:
    """Row of a higher-order emission table: the last `order` symbols, then this one."""
    return ((history * symbols) % F.pow(F.lit(symbols), order + 1).cast("long")) + symbol
