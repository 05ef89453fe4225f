"""Random regression on a time covariate: additive (and permanent) coefficients of Legendre polynomials.

The components of one effect share its inverse matrix. After a first solution with equal variances the coefficients'
covariance K is the mean of their products over animals, with floored eigenvalues; a second solution takes K as it is,
one block of the coefficient matrix for each pair of coefficients.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.operators import design
from kinforge.plans.mixed_model import MixedModel, Solution

#: Observed times are the grid of the curves up to so many; beyond, it has GRID points.
MOST_TIMES, GRID = 50, 21


@dataclass
class Regression:
    model: MixedModel
    solution: Solution
    order: int
    times: np.ndarray
    basis: np.ndarray
    k: dict[str, np.ndarray]

    def names(self, effect: str = "u") -> list[str]:
        return [f"{effect}{i}" for i in range(self.order + 1)]

    def coefficients(self, effect: str = "u") -> DataFrame:
        """(idx, c0, c1, ...)."""
        return self.solution.table(self.model.records.sparkSession, {f"c{i}": n for i, n in enumerate(self.names(effect))})

    def covariance(self, effect: str = "u") -> DataFrame:
        """(effect, row, col, v) of K."""
        k = self.k[effect]
        cells = [(effect, i, j, float(k[i, j])) for i in range(len(k)) for j in range(len(k))]
        return self.model.records.sparkSession.createDataFrame(cells, "effect string, row int, col int, v double")

    def curves(self, effect: str = "u") -> DataFrame:
        """(idx, t, value) on the grid: at most ``MOST_TIMES`` rows an animal, as one array of structs, exploded."""
        cells = [
            F.struct(F.lit(float(t)).alias("t"), sum((F.col(f"c{i}") * float(v) for i, v in enumerate(b)), F.lit(0.0)).alias("value"))
            for t, b in zip(self.times, self.basis, strict=True)
        ]
        return self.coefficients(effect).select("idx", F.explode(F.array(*cells)).alias("x")).select("idx", "x.t", "x.value")


def covariance_of(coefficients: np.ndarray) -> np.ndarray:
    """K = mean of c c' over animals, eigenvalues floored at max(1e-10, 1e-8 max(1, largest))."""
    return floored(coefficients.T @ coefficients / len(coefficients))


def floored(k: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(k)
    return (vectors * np.maximum(values, max(1e-10, 1e-8 * max(1.0, values.max())))) @ vectors.T


def legendre_values(t: np.ndarray, low: float, high: float, order: int) -> np.ndarray:
    """(time, polynomial)."""
    x = 2 * (t - low) / (high - low) - 1
    p = [np.ones_like(x), x]
    for k in range(2, order + 1):
        p.append(((2 * k - 1) * x * p[k - 1] - (k - 1) * p[k - 2]) / k)
    return np.stack([p[k] * ((2 * k + 1) / 2) ** 0.5 for k in range(order + 1)], 1)


def fit(
    records: DataFrame, time: str, n: int, kinv: DataFrame | None, s2: dict[str, float], order: int = 2, factors: list[str] = (),
    covariates: list[str] = (), level: str = "id", permanent: bool = False, refine: bool = True, **solve,
) -> Regression:
    """``records`` (rec, y, level, time, ...); ``s2`` has u, e, and pe if ``permanent``, for every coefficient."""
    low, high, n_times = records.agg(F.min(time), F.max(time), F.count_distinct(time)).first()
    basis = design.legendre(F.col(time).cast("double"), low, high, order)
    rows, effects = records, ["u"] + (["pe"] if permanent else [])
    for e in effects:
        for k, c in enumerate(basis):
            rows = rows.withColumn(f"{e}{k}__phi", c).withColumn(f"{e}{k}__level", F.col(level))
    model = MixedModel(rows).fixed(list(factors), list(covariates))
    for e in effects:
        for k in range(order + 1):
            model.random(f"{e}{k}", f"{e}{k}__level", n, kinv if e == "u" else None, f"{e}{k}__phi")
    variances = {f"{e}{k}": s2[e] for e in effects for k in range(order + 1)} | {"e": s2["e"]}
    solution = model.solve(variances, **solve)
    names = [f"u{k}" for k in range(order + 1)]
    known = {e: floored(solution.mean_products(records.sparkSession, [f"{e}{k}" for k in range(order + 1)])) for e in effects}
    if refine:
        solution = model.solve(variances, together=(names, s2["e"] * np.linalg.inv(known["u"])), **solve)
    if n_times <= MOST_TIMES:
        times = np.array(sorted(float(r[0]) for r in records.select(time).distinct().collect()))
    else:
        times = np.linspace(float(low), float(high), GRID)
    return Regression(model, solution, order, times, legendre_values(times, float(low), float(high), order), known)
