"""Result tables as DataFrames, and their text form: tab-separated, six significant digits, ``nan`` for missing numbers."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.plans.mixed_model import MixedModel, Solution, effects_table, heritability
from kinforge.tables import open_fs

#: Rows that one file may have; a larger table becomes a folder of parts in order.
ONE_FILE = 1_000_000


def cell(v) -> str:
    if v is None:
        return "nan"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def text_lines(df: DataFrame) -> DataFrame:
    """(value) with a line for each row, in the rows' order."""

    def lines(batches):
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(["\t".join(map(cell, r)) for r in rows], pa.string())], ["value"])

    return df.mapInArrow(lines, "value string")


def write_lines(url: str, lines: Iterable[str]) -> None:
    fs, path = open_fs(url)
    if "/" in path:
        fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        for line in lines:
            out.write(f"{line}\n".encode())


def write_table(df: DataFrame, url: str, order: tuple = (), header: bool = True, one_file: int = ONE_FILE) -> None:
    """The table's text; ``order`` names columns that rows are sorted by, those that begin with _ are left out."""
    names = [c for c in df.columns if not c.startswith("_")]
    rows = df.orderBy(*order) if order else df
    if df.count() <= one_file:
        body = (r["value"] for r in text_lines(rows.select(*names)).toLocalIterator())
        write_lines(url, [*(["\t".join(names)] if header else []), *body] if not order else _chain(names if header else None, body))
        return
    lines = text_lines(rows.select(*names))
    if header:
        spark = df.sparkSession
        lines = spark.createDataFrame([("\t".join(names),)], "value string").coalesce(1).union(lines)
    lines.write.mode("overwrite").text(url)


def _chain(names, body):
    if names:
        yield "\t".join(names)
    yield from body


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of the driver's."""
    names = [f.rpartition(" ")[0].strip("` ") for f in schema.split(", ")]
    return spark.createDataFrame(pd.DataFrame(rows, columns=names), schema) if rows else spark.createDataFrame([], schema)


def beta_table(spark: SparkSession, s: Solution) -> DataFrame:
    """(Levels, Estimation, SE)."""
    se = s.se if s.se is not None else np.full(len(s.beta), np.nan)
    return local(spark, [(n, float(b), float(e)) for n, b, e in zip(s.names, s.beta, se, strict=True)], "Levels string, Estimation double, SE double")


def vars_table(spark: SparkSession, s2: dict[str, float], se: dict[str, float] | None = None, repeatability: bool = False) -> DataFrame:
    """(Item, Var, Var_SE, h2, h2_SE, P): a row a component, the residual's last; the repeatability is the share of all
    components but the residual."""
    rows = []
    for r in heritability(s2, se):
        residual = r["item"] == "e"
        rows.append((r["item"], r["var"], (se or {}).get(r["item"], float("nan")), float("nan") if residual else r["share"], float("nan") if residual else r.get("share_se", float("nan")), r.get("p", float("nan"))))
    if repeatability:
        total = sum(s2.values())
        rows.append(("Repeatability", sum(v for k, v in s2.items() if k != "e") / total, *[float("nan")] * 4))
    return local(spark, rows, "Item string, Var double, Var_SE double, h2 double, h2_SE double, P double")


def anova_table(spark: SparkSession, s: Solution) -> DataFrame:
    """(Factors, Df, SumSq, MeanSq, F, P), the residual's row last."""
    den = max(1, s.n - len(s.names))
    nan = float("nan")
    rows = [(r["factor"], r["df"], r["sum_sq"], r["mean_sq"], r["f"], r["p"]) for r in s.anova] + [("e", den, s.s2["e"] * den, s.s2["e"], nan, nan)]
    return local(spark, rows, "Factors string, Df long, SumSq double, MeanSq double, F double, P double")


def rand_table(model: MixedModel, s: Solution, ids: DataFrame, level: str = "id") -> DataFrame:
    """(ID, effects..., residuals, n_obs, _first): effects of every animal of (id, idx) whose component has its level, the
    mean residual and number of its records. Animals with records come first, by their first record, then the others
    by id: sort by (_first nulls last, ID)."""
    fitted = model.fitted(s)
    own = model.records.select("rec", F.col(level).alias("idx")).join(fitted.select("rec", "residual"), "rec")
    sums = own.groupBy("idx").agg(F.avg("residual").alias("residuals"), F.count(F.lit(1)).alias("n_obs"), F.min("rec").alias("_first"))
    out = ids.select(F.col("id").alias("ID"), "idx")
    for c in [c for c in model.components if c.level in (level, f"{c.name}_id")]:
        out = out.join(s.table(ids.sparkSession, {c.name: c.name}), "idx", "left")
    out = out.join(sums, "idx", "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))
    return out.drop("idx")


def obsrand_table(model: MixedModel, s: Solution, names: DataFrame, level: str = "id") -> DataFrame:
    """(Record, ID, Y, Fixed, effects..., Fitted, Residual) of every record; ``names`` is (id, idx)."""
    fitted = model.fitted(s)
    effects = [c.name for c in model.components]
    own = fitted.select("rec", "y", "fixed", *effects, "fitted", "residual").join(model.records.select("rec", F.col(level).alias("idx")), "rec")
    out = own.join(names.select(F.col("id").alias("ID"), "idx"), "idx", "left")
    return out.select(F.col("rec").alias("Record"), "ID", F.col("y").alias("Y"), F.col("fixed").alias("Fixed"), *effects, F.col("fitted").alias("Fitted"), F.col("residual").alias("Residual"))


def inbreeding_table(ped: DataFrame, f: DataFrame) -> DataFrame:
    """(ID, F, _idx)."""
    return ped.select("idx", F.col("id").alias("ID")).join(f.select("idx", F.col("f").alias("F")), "idx").withColumnRenamed("idx", "_idx").select("ID", "F", "_idx")


def coefficients_table(m: DataFrame, ids: DataFrame) -> DataFrame:
    """(id1, id2, rc, _i, _j) of a matrix's lower triangle; ``ids`` is (id, idx)."""
    out = m.where("i >= j").join(ids.select(F.col("idx").alias("i"), F.col("id").alias("id1")), "i")
    out = out.join(ids.select(F.col("idx").alias("j"), F.col("id").alias("id2")), "j")
    return out.select("id1", "id2", F.col("v").alias("rc"), F.col("i").alias("_i"), F.col("j").alias("_j"))


def components_table(spark: SparkSession, vectors: np.ndarray, ids: DataFrame) -> DataFrame:
    """(ID, PC1, PC2, ..., _idx)."""
    pcs = effects_table(spark, {f"PC{k + 1}": vectors[:, k] for k in range(vectors.shape[1])})
    return ids.select(F.col("id").alias("ID"), "idx").join(pcs, "idx").select("ID", *[f"PC{k + 1}" for k in range(vectors.shape[1])], F.col("idx").alias("_idx"))


def frequency_table(variants: DataFrame, f: DataFrame) -> DataFrame:
    """(CHR, SNP, A1, A2, FREQ_A1, _snp); the frequency is that of the allele that dosages count, A1."""
    out = variants.join(f.select("snp", "p"), "snp")
    return out.select(F.col("chrom").alias("CHR"), F.col("id").alias("SNP"), F.col("a1").alias("A1"), F.col("a2").alias("A2"), F.col("p").alias("FREQ_A1"), F.col("snp").alias("_snp"))


def rate_table(samples: DataFrame, quality: DataFrame, what: str) -> DataFrame:
    """(ID, count, TOTAL_VALID, rate, _sample) of ``homo`` or ``het`` genotypes."""
    out = samples.select("sample", F.col("iid").alias("ID")).join(quality, "sample")
    return out.select("ID", F.col(what).alias("count"), F.col("valid").alias("TOTAL_VALID"), F.coalesce(F.try_divide(what, "valid"), F.lit(0.0)).alias("rate"), F.col("sample").alias("_sample"))


def snp_qc_table(variants: DataFrame, quality: DataFrame, passing: DataFrame) -> DataFrame:
    """(CHR, SNP, A1, A2, HOM1, HET, HOM2, MISS, MAF, HWE_P, PASS, _snp)."""
    from kinforge.functions.stats import with_hwe

    out = variants.join(with_hwe(quality, "n0", "n1", "n2"), "snp").join(passing.select("snp", F.lit(1).alias("ok")), "snp", "left")
    cols = {"chrom": "CHR", "id": "SNP", "a1": "A1", "a2": "A2", "n0": "HOM1", "n1": "HET", "n2": "HOM2", "miss_rate": "MISS", "maf": "MAF", "hwe_p": "HWE_P"}
    return out.select(*[F.col(a).alias(b) for a, b in cols.items()], F.coalesce("ok", F.lit(0)).alias("PASS"), F.col("snp").alias("_snp"))


def sample_qc_table(samples: DataFrame, quality: DataFrame, mind: float = 1.0) -> DataFrame:
    """(FID, IID, MISS_RATE, HET_RATE, PASS, _sample)."""
    out = samples.select("sample", F.col("fid").alias("FID"), F.col("iid").alias("IID")).join(quality, "sample")
    return out.select("FID", "IID", F.col("miss_rate").alias("MISS_RATE"), F.col("het_rate").alias("HET_RATE"), (F.col("miss_rate") <= mind).cast("int").alias("PASS"), F.col("sample").alias("_sample"))


def snp_effect_table(variants: DataFrame, f: DataFrame, effects: DataFrame) -> DataFrame:
    """(CHR, SNP, BP, A1, A2, FREQ, EFFECT, _snp)."""
    out = variants.join(f.select("snp", "p"), "snp").join(effects.select("snp", "effect"), "snp")
    cols = {"chrom": "CHR", "id": "SNP", "pos": "BP", "a1": "A1", "a2": "A2", "p": "FREQ", "effect": "EFFECT", "snp": "_snp"}
    return out.select(*[F.col(a).alias(b) for a, b in cols.items()])


def sblup_table(variants: DataFrame, effects: DataFrame) -> DataFrame:
    """(SNP, A1, A2, SBLUP_EFFECT, _snp)."""
    out = variants.join(effects.select("snp", "effect"), "snp")
    return out.select(F.col("id").alias("SNP"), F.col("a1").alias("A1"), F.col("a2").alias("A2"), F.col("effect").alias("SBLUP_EFFECT"), F.col("snp").alias("_snp"))


def profile_table(samples: DataFrame, scores: DataFrame) -> DataFrame:
    """(ID, SCORE, _sample)."""
    out = samples.select("sample", F.col("iid").alias("ID")).join(scores, "sample")
    return out.select("ID", F.col("score").alias("SCORE"), F.col("sample").alias("_sample"))


def trait_vars_table(spark: SparkSession, vg: np.ndarray, ve: np.ndarray) -> DataFrame:
    """(Trait1, Trait2, Vg, Ve), all pairs, numbered from 1."""
    t = len(vg)
    return local(spark, [(i + 1, j + 1, float(vg[i, j]), float(ve[i, j])) for i in range(t) for j in range(t)], "Trait1 long, Trait2 long, Vg double, Ve double")


def matrix_table(m: DataFrame, zero: float = 1e-9) -> DataFrame:
    """(i, j, v) of the lower triangle, numbered from 1, without entries of at most ``zero``."""
    return m.where((F.col("i") >= F.col("j")) & (F.abs("v") > zero)).select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), "v")


def write_packed(m: DataFrame, n: int, url: str, magic: bytes, header: bytes) -> None:
    """A symmetric matrix's upper triangle, column by column, as float64: columns come in order through the driver, one at
    a time, so a matrix of any order is written with one column in memory."""
    rows = m.where("i >= j").groupBy("i").agg(F.collect_list(F.struct("j", "v")).alias("row")).orderBy("i")
    fs, path = open_fs(url)
    if "/" in path:
        fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(magic.ljust(32, b"\0") + header)
        at = 0
        for r in rows.toLocalIterator():
            while at <= r["i"]:
                column = np.zeros(at + 1)
                if at == r["i"]:
                    for j, v in r["row"]:
                        column[j] = v
                out.write(column.astype("<f8").tobytes())
                at += 1
        for k in range(at, n):
            out.write(np.zeros(k + 1).tobytes())
