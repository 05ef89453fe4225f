"""Views of the driver's tables as records, pedigrees, genotypes and effects (deterministic, the same in SQL)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.operators.genotypes import plane_rows

#: Genotypes of a task.
TASK_CELLS = 128_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phenotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated records of customers: y, two factors, one covariate."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("rec"), F.col("o_custkey").alias("id"), (F.col("o_totalprice") / 1000).alias("y"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), F.month("o_orderdate").cast("double").alias("mon"),
    )


def pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth customer is the child of two founders."""
    k = F.col("c_custkey")
    sire = F.when((k % 4 == 3) & (k >= 7), F.floor(k / 8) * 4)
    return table(spark, sf_dir, "customer").select(k.alias("idx"), sire.alias("sire"), (sire + 1).alias("dam"))


def deep_pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("idx"), F.when(k >= 4, F.floor(k / 2)).alias("sire"), F.when(k >= 4, F.floor(k / 3)).alias("dam"))


def genotypes(spark: SparkSession, sf_dir: str, window: int = 1) -> DataFrame:
    """(snp, dosage) of all parts, as bits: a place for every supplier; every part carries its dosages, so nothing is joined.
    Parts are dealt to tasks by range before they carry any; ``window`` consecutive ones stay in one partition, in order.

    A dosage depends on the sample's number modulo 4 and modulo 7 only, so the bits of 56 samples are repeated."""
    n, keys = n_samples(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("snp"))
    m = keys.count()
    parts = max(-(-n * m // TASK_CELLS), min(m // 1000 + 1, 2 * spark.sparkContext.defaultParallelism))
    size = -(-n // 8)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.arange(56)
        last = np.full(size, 255, np.uint8)
        if n % 8:
            last[-1] = (1 << n % 8) - 1
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                snp = batch.column("snp").slice(at, 1024)
                p = snp.to_numpy()[:, None]
                code = ((s * 31 + p * 17 + (s * p) % 7) % 4).astype(np.uint8)
                planes = [np.tile(np.packbits((code >> k) & 1, axis=1, bitorder="little"), (1, -(-size // 7)))[:, :size] & last for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([snp, plane_rows(*planes, n)], ["snp", "dosage"])

    rows = keys.repartitionByRange(int(parts), F.floor(F.col("snp") / window)).sortWithinPartitions("snp")
    return rows.mapInArrow(carry, "snp long, dosage binary")


def n_samples(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "supplier").count()


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(snp, id, a1, a2)."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("snp"), F.col("p_name").alias("name"), F.concat(F.lit("rs"), F.col("p_partkey")).alias("id"), F.lit("A").alias("a1"), F.lit("C").alias("a2"))


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, a1, a2, beta): some with swapped alleles, some with foreign ones."""
    k = F.col("p_size") % 3
    a = lambda x, y: F.when(k == 0, x).when(k == 1, y).otherwise("G")
    return table(spark, sf_dir, "part").select(F.concat(F.lit("rs"), F.col("p_partkey")).alias("id"), a("A", "C").alias("a1"), a("C", "A").alias("a2"), (F.col("p_retailprice") / 1e5).alias("beta"))


PHENO = """pheno AS (SELECT o_orderkey AS rec, o_custkey AS id, o_totalprice / 1000 AS y, o_orderpriority AS priority,
  o_orderstatus AS status, month(o_orderdate)::DOUBLE AS mon FROM orders)"""
PED = """ped AS (SELECT c_custkey AS idx, CASE WHEN c_custkey % 4 = 3 AND c_custkey >= 7 THEN (c_custkey // 8) * 4 END AS sire,
  CASE WHEN c_custkey % 4 = 3 AND c_custkey >= 7 THEN (c_custkey // 8) * 4 + 1 END AS dam FROM customer)"""
DEEP = """deep AS (SELECT c_custkey AS idx, CASE WHEN c_custkey >= 4 THEN c_custkey // 2 END AS sire,
  CASE WHEN c_custkey >= 4 THEN c_custkey // 3 END AS dam FROM customer)"""
GENO = """geno AS (SELECT snp, sample, CASE WHEN g <> 3 THEN g::DOUBLE END AS dosage FROM
  (SELECT p_partkey AS snp, s_suppkey AS sample, (s_suppkey * 31 + p_partkey * 17 + (s_suppkey * p_partkey) % 7) % 4 AS g
   FROM part, supplier))"""
FREQ = """freq AS (SELECT snp, avg(dosage) / 2 AS p, var_pop(dosage) AS var, count(dosage) AS valid FROM geno GROUP BY snp),
  ok AS (SELECT * FROM freq WHERE least(p, 1 - p) >= 0.01 AND p > 0 AND p < 1)"""
EFFECTS = """eff AS (SELECT p_partkey AS snp, p_retailprice / 1e5 AS raw, p_size % 3 AS k FROM part),
  beta AS (SELECT snp, CASE WHEN k = 0 THEN raw ELSE -raw END AS beta FROM eff WHERE k < 2)"""
