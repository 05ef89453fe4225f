"""Fixed-effect design, cross products, and random levels, all over records (rec, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def factor_levels(rows: DataFrame, factor: str) -> DataFrame:
    """(level, place): levels in byte order, place 0 is the base."""
    levels = rows.select(F.col(factor).cast("string").alias("level")).where("level is not null").distinct()
    return levels.select("level", (F.row_number().over(Window.orderBy("level")) - 1).alias("place"))


def columns_of(rows: DataFrame, factors: list[str], covariates: list[str]) -> list[tuple[str, str, str | None]]:
    """(name, source, level): mu, then each factor's levels but the base, then covariates."""
    out: list[tuple[str, str, str | None]] = [("mu", "", None)]
    for f in factors:
        levels = [r["level"] for r in factor_levels(rows, f).where("place > 0").orderBy("place").collect()]
        out += [(f"{f}_{v}", f, v) for v in levels]
    return out + [(c, c, None) for c in covariates]


def long_design(rows: DataFrame, factors: list[str], covariates: list[str]) -> DataFrame:
    """(rec, name, val), zeros left out; levels come from a join, so their number is not bounded by the plan."""
    parts = [rows.select("rec", F.lit("mu").alias("name"), F.lit(1.0).alias("val"))]
    for f in factors:
        other = factor_levels(rows, f).where("place > 0").select(F.col("level").alias(f))
        parts.append(rows.select("rec", F.col(f).cast("string").alias(f)).join(other, f).select("rec", F.concat(F.lit(f"{f}_"), F.col(f)).alias("name"), F.lit(1.0).alias("val")))
    parts += [rows.select("rec", F.lit(c).alias("name"), F.col(c).cast("double").alias("val")).where("val <> 0") for c in covariates]
    return reduce(DataFrame.unionByName, parts)


def wide_columns(columns: list[tuple[str, str, str | None]]) -> list[Column]:
    """The design's columns as expressions over the records: no shuffle for a bounded number of them."""
    return [
        F.lit(1.0) if not source else F.col(source).cast("double") if level is None else F.when(F.col(source).cast("string") == level, 1.0).otherwise(0.0)
        for _, source, level in columns
    ]


def cross_wide(rows: DataFrame, columns: list[tuple[str, str, str | None]], y: str = "y"):
    """(X'X, X'y, y'y, n) on the driver from one map-side combined aggregation over the records."""
    import numpy as np

    x = wide_columns(columns)
    p = len(x)
    sums = [F.sum(x[a] * x[b]) for a in range(p) for b in range(a, p)] + [F.sum(c * F.col(y)) for c in x] + [F.sum(F.col(y) * F.col(y)), F.count(F.lit(1))]
    got = [v or 0.0 for v in rows.agg(*sums).first()]
    xx = np.zeros((p, p))
    it = iter(got)
    for a in range(p):
        for b in range(a, p):
            xx[a, b] = xx[b, a] = next(it)
    return xx, np.array([next(it) for _ in range(p)]), float(next(it)), int(next(it))


def legendre(t: Column, low: float, high: float, order: int) -> list[Column]:
    """Normalised Legendre polynomials of time scaled to [-1, 1]; a constant time is an error."""
    if not high > low:
        raise ValueError("time is constant")
    x = (t - low) * 2.0 / (high - low) - 1.0
    p = [F.lit(1.0), x]
    for k in range(2, order + 1):
        p.append(((2 * k - 1) * x * p[k - 1] - (k - 1) * p[k - 2]) / k)
    return [p[k] * ((2 * k + 1) / 2) ** 0.5 for k in range(order + 1)]
