"""Joins of records, animals and samples by id. Ids are strings; indexes are places in a matrix, from 0."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def known_records(records: DataFrame, ids: DataFrame, id_name: str = "id") -> DataFrame:
    """Records of the animals in (id, idx), with their idx; an animal may have many records."""
    return records.join(ids.select(F.col("id").alias(id_name), "idx"), id_name)


def unknown_count(records: DataFrame, ids: DataFrame, id_name: str = "id") -> int:
    """Records whose id is not among the ids."""
    return records.join(ids.select(F.col("id").alias(id_name)), id_name, "left_anti").count()


def aligned_records(records: DataFrame, ids: DataFrame, id_name: str = "id") -> DataFrame:
    """One row for each (id, idx), in the order of the matrix: its record, or nulls."""
    return ids.select(F.col("id").alias(id_name), "idx").join(records, id_name, "left")


def complete_cases(records: DataFrame, traits: list[str]) -> DataFrame:
    """Records with a finite number for every trait."""
    out = records
    for t in traits:
        out = out.where(F.col(t).isNotNull() & ~F.isnan(t) & (F.abs(t) < float("inf")))
    return out


def in_pedigree(samples: DataFrame, ped: DataFrame, strict: bool = False) -> DataFrame:
    """(sample, id, idx): genotyped animals with their index in the pedigree (id, idx), null if it lacks them; that is an
    error if ``strict``."""
    out = samples.select("sample", "id").join(ped.select("id", "idx"), "id", "left").select("sample", "id", "idx")
    if strict and (lost := out.where("idx is null").count()):
        raise ValueError(f"{lost} genotyped animals are not in the pedigree")
    return out


def sample_aliases(samples: DataFrame) -> DataFrame:
    """(id, sample) by which phenotypes may name samples (sample, fid, iid): FID:IID, and IID where one sample has it and
    no FID:IID is the same."""
    whole = samples.select(F.concat_ws(":", "fid", "iid").alias("id"), "sample")
    short = samples.groupBy("iid").agg(F.count(F.lit(1)).alias("n"), F.min("sample").alias("sample")).where("n = 1")
    short = short.select(F.col("iid").alias("id"), "sample").join(whole.select("id"), "id", "left_anti")
    return whole.unionByName(short)


def normalised_parents(ped: DataFrame, n: int | None = None) -> DataFrame:
    """Pedigree (idx, sire, dam) whose parents are animals of it; others (negative, beyond the last, itself) are unknown."""
    n = n if n is not None else int((ped.agg(F.max("idx")).first()[0] if not ped.isEmpty() else -1)) + 1
    fit = lambda c: F.when((F.col(c) >= 0) & (F.col(c) < n) & (F.col(c) != F.col("idx")), F.col(c))
    return ped.withColumns({c: fit(c) for c in ("sire", "dam")})
