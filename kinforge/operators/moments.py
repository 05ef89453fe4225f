"""Sums over records, pairs of relatives and matrices that models start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinforge.operators import design
from kinforge.operators.pedigree import numbered


def cross_products(rows: DataFrame, factors: list[str], covariates: list[str]) -> DataFrame:
    """X'X as (c1, c2, v), entries other than 0, from one map-side combined aggregation of the records: no join, no shuffle
    of records. Its order is the number of columns."""
    columns = design.columns_of(rows, factors, covariates)
    xx, _, _, _ = design.cross_wide(rows, columns)
    cells = [(a[0], b[0], float(xx[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns) if xx[i, j]]
    return rows.sparkSession.createDataFrame(cells, "c1 string, c2 string, v double")


def right_side(rows: DataFrame, factors: list[str], covariates: list[str], y: str = "y") -> DataFrame:
    """X'y as (name, v), by one aggregation of the records."""
    columns = design.columns_of(rows, factors, covariates)
    _, xy, _, _ = design.cross_wide(rows, columns, y)
    return rows.sparkSession.createDataFrame([(c[0], float(v)) for c, v in zip(columns, xy, strict=True)], "name string, v double")


def level_counts(rows: DataFrame, level: str = "id") -> DataFrame:
    """Z'Z of a term whose levels are a column: (i, v), its diagonal; there is nothing beside it."""
    return rows.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("i")).agg(F.count(F.lit(1)).alias("v"))


def subject_variances(rows: DataFrame, subject: str = "id", y: str = "y") -> DataFrame:
    """(subjects, within, between_means): the variance of records within subjects, and of the subjects' means."""
    m = rows.groupBy(subject).agg(F.avg(y).alias("mean"), F.count(F.lit(1)).alias("n"), F.var_pop(y).alias("v"))
    within = F.try_divide(F.sum(F.col("n") * F.col("v")), F.sum(F.col("n") - 1))
    return m.agg(F.count(F.lit(1)).alias("subjects"), within.alias("within"), F.var_samp("mean").alias("between_means"))


def subject_means(rows: DataFrame, of: dict[str, Column], subject: str = "id") -> DataFrame:
    """(subject, one mean for each of ``of``, n_obs)."""
    return rows.groupBy(subject).agg(*[F.avg(c).alias(n) for n, c in of.items()], F.count(F.lit(1)).alias("n_obs"))


def relative_moments(a: DataFrame, r: DataFrame) -> DataFrame:
    """Haseman-Elston sums (aa, ayy, pairs) over the entries below the diagonal of a sparse matrix (i, j, v) whose animals
    have residuals (id, r): only entries are joined, never all pairs."""
    pairs = a.where("i > j").join(r.toDF("i", "ri"), "i").join(r.toDF("j", "rj"), "j")
    v = F.col("v")
    return pairs.agg(F.sum(v * v).alias("aa"), F.sum(v * F.col("ri") * F.col("rj")).alias("ayy"), F.count(F.lit(1)).alias("pairs"))


def centred_means(rows: DataFrame, subject: str = "id", y: str = "y") -> DataFrame:
    """(subject, r): the subjects' means less the mean of means."""
    m = rows.groupBy(subject).agg(F.avg(y).alias("y"))
    return m.crossJoin(F.broadcast(m.agg(F.avg("y").alias("mean")))).select(subject, (F.col("y") - F.col("mean")).alias("r"))


def mean_entries(m: DataFrame) -> DataFrame:
    """(diagonal, off): means of a matrix's entries on the diagonal and beside it."""
    on = F.col("i") == F.col("j")
    return m.agg(F.avg(F.when(on, F.col("v"))).alias("diagonal"), F.avg(F.when(~on, F.col("v"))).alias("off"))


def first_core(samples: DataFrame, size: int, order: str = "sample") -> DataFrame:
    """(sample, core): whether a sample is among the first ``size``."""
    return numbered(samples.select(order), order).select(order, (F.col("number") < size).alias("core"))
