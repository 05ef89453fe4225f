"""Streams of genotype rows: counts and scores are sums, so they are plain stateful aggregations.

Both take a streaming DataFrame of (snp, sample, dosage) and return a streaming aggregate (output mode update or
complete); state grows with variants or samples, not with rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.operators.genotypes import snp_counts


def streaming_counts(rows: DataFrame) -> DataFrame:
    return snp_counts(rows)


def streaming_scores(rows: DataFrame, effects: DataFrame) -> DataFrame:
    """(sample, score) over a static table of (snp, beta)."""
    return rows.where("dosage is not null").join(effects, "snp").groupBy("sample").agg(F.sum(F.col("dosage") * F.col("beta")).alias("score"))
