"""Functions that Spark lacks: exact Hardy-Weinberg test, normal and F tails."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def hwe_exact(hom1: int, het: int, hom2: int) -> float:
    """Two-sided exact test: the probability of all heterozygote counts no likelier than the one seen."""
    n, rare = hom1 + het + hom2, 2 * min(hom1, hom2) + het
    if n == 0:
        return 1.0
    counts = np.arange(rare % 2, rare + 1, 2)
    below = counts[:-1].astype(float)
    # ratio of a count's probability to that of two heterozygotes fewer: both homozygotes give one each
    ratio = np.log((rare - below) * (2.0 * n - rare - below)) - np.log((below + 2) * (below + 1))
    log_p = np.concatenate(([0.0], np.cumsum(ratio)))
    p = np.exp(log_p - log_p.max())
    p /= p.sum()
    return float(min(1.0, p[p <= p[(het - rare % 2) // 2] * (1 + 1e-9)].sum()))


@F.pandas_udf(DoubleType())
def _hwe(hom1: pd.Series, het: pd.Series, hom2: pd.Series) -> pd.Series:
    return pd.Series([hwe_exact(int(a), int(b), int(c)) for a, b, c in zip(hom1, het, hom2, strict=True)], dtype=float)


def with_hwe(counts: DataFrame, hom1: str, het: str, hom2: str) -> DataFrame:
    """Adds ``hwe_p``; each distinct triple of counts is tested once."""
    keys = [hom1, het, hom2]
    tested = counts.select(*keys).distinct().withColumn("hwe_p", _hwe(*keys))
    return counts.join(tested, keys)


def normal_tail(estimate: float, se: float) -> float:
    """Two-sided p of estimate / se; 1 where se is practically zero."""
    return 1.0 if se < 1e-12 else math.erfc(abs(estimate / se) / math.sqrt(2))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        term = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + term * d if abs(1 + term * d) > tiny else tiny)
        c = 1 + term / c if abs(1 + term / c) > tiny else tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def f_tail(f: float, df1: float, df2: float) -> float:
    return 1.0 if f <= 0 else incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))
