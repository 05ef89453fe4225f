"""Matrices as rows (i, j, v) and vectors as rows (i, v)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.tables import written


def add(*parts: DataFrame) -> DataFrame:
    """Sum of matrices: union, then one map-side combined aggregation."""
    return reduce(DataFrame.unionByName, parts).groupBy("i", "j").agg(F.sum("v").alias("v"))


def scale(m: DataFrame, by: float) -> DataFrame:
    return m.select("i", "j", (F.col("v") * by).alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def identity(spark, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def multiply(m: DataFrame, x: DataFrame) -> DataFrame:
    """Matrix times vector."""
    return m.join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def full_of(triangle: DataFrame) -> DataFrame:
    """Both triangles from either one."""
    return triangle.select("i", "j", "v").union(triangle.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def remap(m: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows and columns renumbered by (old, new); entries without a new number go."""
    ids = ids.select("old", "new")
    rows = m.join(ids.toDF("i", "ni"), "i").join(ids.toDF("j", "nj"), "j")
    return rows.select(F.col("ni").alias("i"), F.col("nj").alias("j"), "v")


def hadamard_square(m: DataFrame) -> DataFrame:
    return m.select("i", "j", (F.col("v") * F.col("v")).alias("v"))


def sparse(m: DataFrame, least: float = 0.05) -> DataFrame:
    """The lower triangle's entries of at least that size."""
    return m.where((F.col("i") >= F.col("j")) & (F.abs("v") >= least))


def mirrored(m: DataFrame, floor: float = 1e-10) -> DataFrame:
    """Half the sum with the transpose, tiny diagonals raised to ``floor``."""
    half = add(scale(m, 0.5), scale(transpose(m), 0.5))
    return half.withColumn("v", F.when((F.col("i") == F.col("j")) & (F.abs("v") < 1e-14), F.lit(floor)).otherwise(F.col("v")))


def dense(m: DataFrame, n: int, cap: int = 6000) -> np.ndarray:
    """The matrix on the driver, if its order is within the cap."""
    if n > cap:
        raise ValueError(f"order {n} is beyond the dense cap of {cap}")
    pdf = m.toPandas()
    out = np.zeros((n, n))
    np.add.at(out, (pdf["i"].to_numpy(np.int64), pdf["j"].to_numpy(np.int64)), pdf["v"].to_numpy(float))
    return out


def by_one_task(m: DataFrame, n: int, of: Callable[[np.ndarray], np.ndarray], cap: int = 12_000) -> DataFrame:
    """The rows, written once, of what ``of`` makes of the dense matrix: it is gathered by one task, not by the driver."""
    if n > cap:
        raise ValueError(f"order {n} is beyond the cap of {cap}")

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        x = np.zeros((n, n))
        np.add.at(x, (table["i"].to_numpy(), table["j"].to_numpy()), table["v"].to_numpy())
        x = of(x)
        for at in range(0, n, max(1, 1_000_000 // n)):
            i, j = np.nonzero(x[at : at + max(1, 1_000_000 // n)])
            yield pa.RecordBatch.from_arrays([pa.array(i + at), pa.array(j), pa.array(x[i + at, j])], ["i", "j", "v"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from run(pa.Table.from_batches(held))

    rows = m.select(F.col("i").cast("long"), F.col("j").cast("long"), F.col("v").cast("double")).repartition(1)
    return written(rows.mapInArrow(whole, "i long, j long, v double"), "by-one-task")


def repair_signs(m: DataFrame, share: float = 0.6) -> DataFrame:
    """Negates all off-diagonal entries if more than ``share`` of them are positive, as inverses written with the wrong
    sign have them; for matrices other than inverses of genomic ones."""
    off, positive = m.agg(F.count_if(F.col("i") != F.col("j")), F.count_if((F.col("i") != F.col("j")) & (F.col("v") > 0))).first()
    if not off or positive <= share * off:
        return m
    return m.withColumn("v", F.when(F.col("i") != F.col("j"), -F.col("v")).otherwise(F.col("v")))


def h_inverse(a_inverse: DataFrame, g_inverse: DataFrame, a22_inverse: DataFrame, typed: DataFrame | None = None, tau: float = 1.0, omega: float = 1.0) -> DataFrame:
    """A^-1 + tau G^-1 - omega A22^-1 as rows (i, j, v): a union and one sum. ``typed`` is (sample, idx): the places of G's
    animals in A; those without one take no part."""
    parts = [scale(g_inverse, tau), scale(a22_inverse, -omega)]
    if typed is not None:
        ids = typed.where("idx is not null").select(F.col("sample").alias("old"), F.col("idx").alias("new"))
        parts = [remap(p, ids) for p in parts]
    return add(a_inverse.select("i", "j", "v"), *parts)


def h_matrix(a: np.ndarray, g: np.ndarray, typed: np.ndarray) -> np.ndarray:
    """H itself, within the dense cap: A with the block of the genotyped animals replaced by G and the others' relationships
    adjusted through it, so that it is the inverse of H^-1 with tau and omega of 1."""
    rest = np.setdiff1d(np.arange(len(a)), typed)
    t = np.linalg.solve(a[np.ix_(typed, typed)], a[np.ix_(typed, rest)])
    out = np.empty_like(a)
    out[np.ix_(typed, typed)] = g
    out[np.ix_(typed, rest)] = g @ t
    out[np.ix_(rest, typed)] = (g @ t).T
    out[np.ix_(rest, rest)] = a[np.ix_(rest, rest)] + t.T @ (g - a[np.ix_(typed, typed)]) @ t
    return out
