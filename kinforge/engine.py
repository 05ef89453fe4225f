"""From files to answers: relationship exports, quality control, scores, and the models, by one set of options."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge import sinks
from kinforge.operators import coo, design, joins
from kinforge.operators import genotypes as G
from kinforge.operators import pedigree as P
from kinforge.plans import random_regression as RR
from kinforge.plans import variance as V
from kinforge.plans.mixed_model import MixedModel, Solution
from kinforge.sources import genotypes as GS
from kinforge.sources import matrices as M
from kinforge.sources import text as T

LOG = logging.getLogger("kinforge")


@dataclass
class Options:
    """What a run may be told; empty means not given."""

    out: str = ""
    task: str = "blup"
    model: str = ""
    relationship: str = ""
    ped: str = ""
    bfile: str = ""
    pfile: str = ""
    bgen: str = ""
    pheno: str = ""
    pheno_name: str = ""
    pheno_pos: int = 0
    id_col: str = ""
    factors: list[str] = field(default_factory=list)
    covariates: list[str] = field(default_factory=list)
    randoms: list[str] = field(default_factory=list)
    time_col: str = ""
    order: int = 2
    pe: bool = False
    mat: bool = False
    dom: bool = False
    epi: bool = False
    matrix: str = ""
    matrix_id: str = ""
    inv: str = ""
    inv_a: str = ""
    inv_g: str = ""
    inv_a22: str = ""
    id_a: str = ""
    id_g: str = ""
    variances: str = ""
    priors: list[float] = field(default_factory=list)
    vce: bool = False
    skip_vce: bool = False
    vce_mode: str = "ai"
    vce_rounds: int = 100
    vce_tol: float = 1e-6
    se: bool = True
    matrix_free: bool = False
    snp_effect: bool = False
    tau: float = 1.0
    omega: float = 1.0
    alpha: float = 0.05
    tune: bool = True
    ridge: float = 0.0
    code_method: int = G.VANRADEN
    apy: bool = False
    apy_core_size: int = 0
    apy_core_file: str = ""
    pop_class: str = ""
    snp_weight: str = ""
    make_matrix: bool = False
    make_inv: bool = False
    add_inv: bool = False
    dom_inv: bool = False
    epi_inv: bool = False
    output_format: str = "txt"
    magic: str = ""
    ibc: bool = False
    rc: bool = False
    pca: bool = False
    npc: int = 10
    allele_freq: bool = False
    homo: bool = False
    hete: bool = False
    maf: float = 0.0
    max_maf: float = 1.0
    hwe: float = 0.0
    geno: float = 1.0
    mind: float = 1.0
    sumstat: str = ""
    score: str = ""
    h2: float = 0.0
    window: int = 1000
    pcg_tol: float = 1e-10
    pcg_rounds: int = 10_000


@dataclass
class Genotypes:
    packed: DataFrame
    variants: DataFrame
    samples: DataFrame
    n: int
    m: int


@dataclass
class Kinship:
    """K and its inverse as rows (i, j, v), over (id, idx)."""

    ids: DataFrame
    n: int
    kinv: DataFrame
    k: DataFrame | None = None
    label: str = "PA"


class Engine:
    def __init__(self, spark: SparkSession, options: Options):
        self.spark, self.o = spark, options

    # inputs

    def lines(self, path: str) -> DataFrame:
        return T.lines(self.spark, path)

    def genotypes(self) -> Genotypes:
        o = self.o
        if o.bfile:
            samples, variants = GS.fam(self.spark, f"{o.bfile}.fam"), GS.bim(self.spark, f"{o.bfile}.bim")
            n, m = samples.count(), variants.count()
            packed = GS.bed(self.spark, f"{o.bfile}.bed", n, m)
        elif o.pfile:
            samples, variants = GS.psam(self.spark, f"{o.pfile}.psam"), GS.pvar(self.spark, f"{o.pfile}.pvar")
            n, m = samples.count(), variants.count()
            packed = GS.pgen(self.spark, f"{o.pfile}.pgen", n, m)
        elif o.bgen:
            variants, packed = GS.bgen(self.spark, o.bgen)
            n, m = G.width(packed), variants.count()
            names = GS.bgen_samples(o.bgen) or [str(i + 1) for i in range(n)]
            samples = sinks.local(self.spark, [(i, "0", s) for i, s in enumerate(names)], "sample long, fid string, iid string")
        else:
            raise ValueError("no genotypes: give --bfile, --pfile or --bgen")
        if o.snp_weight:
            weights = T.snp_weights(self.lines(o.snp_weight))
            variants = variants.join(weights, "id")
        return Genotypes(packed, variants, samples, n, m)

    def g_rows(self, g: Genotypes, method: int | None = None) -> DataFrame:
        """Both triangles of the genomic matrix."""
        if self.o.pop_class and method is None:
            groups = G.classes(g.samples, T.populations(self.lines(self.o.pop_class)))
            return G.full(G.population_relationship(g.packed, groups, g.n))
        weights = g.variants.select("snp", "weight") if self.o.snp_weight else None
        return G.full(G.relationship(g.packed, g.n, method or self.o.code_method or G.YANG, weights=weights))

    def dense(self, m: DataFrame, n: int) -> np.ndarray:
        return coo.dense(m, n, 20_000)

    def rows(self, m: np.ndarray) -> DataFrame:
        return M.coo(self.spark, m)

    def inverse(self, m: DataFrame, n: int) -> DataFrame:
        if self.o.apy:
            core = self.spark.range(min(n, self.o.apy_core_size or n)).toDF("i")
            if self.o.apy_core_file:
                flags = T.core_flags(self._sample_ids.withColumnRenamed("idx", "sample"), self.lines(self.o.apy_core_file))
                core = flags.where("core").select(F.col("sample").alias("i"))
            return G.apy_blocks(m, core, self.o.ridge)
        return self.rows(G.psd_inverse(self.dense(m, n), self.o.ridge))

    def kinship(self) -> Kinship:
        """The matrix of the main genetic effect, by what is given: an inverse or matrix from outside, else A, G or H."""
        o = self.o
        if o.inv_a and o.inv_g and o.inv_a22:
            ids = T.id_list(self.lines(o.id_a))
            typed = joins.in_pedigree(T.id_list(self.lines(o.id_g)).withColumnRenamed("idx", "sample"), ids, strict=True)
            parts = [self.matrix_file(p, i.count()) for p, i in ((o.inv_a, ids), (o.inv_g, typed), (o.inv_a22, typed))]
            return Kinship(ids, ids.count(), coo.h_inverse(coo.repair_signs(parts[0]), parts[1], coo.repair_signs(parts[2]), typed, o.tau, o.omega), label="HA")
        if o.inv:
            path, id_path = (o.inv, o.matrix_id) if o.matrix_id else T.inverse_files(o.inv)
            ids = T.id_list(self.lines(id_path))
            m = self.matrix_file(path, ids.count())
            return Kinship(ids, ids.count(), m if "ginv" in path.lower() else coo.repair_signs(m), label=T.label_of(path))
        if o.matrix:
            ids = T.id_list(self.lines(o.matrix_id))
            n = ids.count()
            k = self.matrix_file(o.matrix, n)
            return Kinship(ids, n, self.inverse(k, n), k, T.label_of(o.matrix))
        kind = o.relationship or {"pblup": "a", "gblup": "g", "ssgblup": "h"}.get(o.model.lower(), "")
        typed = bool(o.bfile or o.pfile or o.bgen)
        kind = kind or ("h" if o.ped and typed else "g" if typed else "a")
        if kind == "a":
            ped, d = self.pedigree()
            return Kinship(ped.select("id", "idx"), ped.count(), P.a_inverse(ped, d), label="PA")
        g = self.genotypes()
        self._sample_ids = g.samples.select(F.col("iid").alias("id"), F.col("sample").alias("idx"))
        if kind == "g":
            k = self.g_rows(g)
            return Kinship(self._sample_ids, g.n, self.inverse(k, g.n), k, "GA")
        ped, d = self.pedigree()
        found = joins.in_pedigree(g.samples.select("sample", F.col("iid").alias("id")), ped)
        if lost := found.where("idx is null").count():
            LOG.warning("%s genotyped animals are not in the pedigree and take no part", lost)
        block = P.relationship(ped, d, found.where("idx is not null").select("idx"))
        back = found.where("idx is not null").select(F.col("idx").alias("old"), F.col("sample").alias("new"))
        a22 = coo.add(coo.remap(block, back), found.where("idx is null").select(F.col("sample").alias("i"), F.col("sample").alias("j"), F.lit(1.0).alias("v")))
        blended = G.blend_rows(self.g_rows(g), a22, o.alpha, o.tune)
        parts = self.inverse(blended, g.n), self.rows(G.psd_inverse(self.dense(a22, g.n), o.ridge))
        self._h = (ped, d, found, blended)
        return Kinship(ped.select("id", "idx"), ped.count(), coo.h_inverse(P.a_inverse(ped, d), *parts, found, o.tau, o.omega), label="HA")

    def pedigree(self) -> tuple[DataFrame, DataFrame]:
        from kinforge.tables import written

        if not self.o.ped:
            raise ValueError("no pedigree: give --ped")
        ped = written(T.pedigree(self.lines(self.o.ped)), "pedigree")
        return ped, P.inbreeding(ped)

    def matrix_file(self, path: str, n: int) -> DataFrame:
        if path.endswith(".bin"):
            return M.binary_rows(self.spark, path, n)
        return T.triplets(self.lines(path))

    def records(self, ids: DataFrame, traits: bool = False) -> DataFrame:
        """(rec, id, idx, y, factors, covariates, randoms) of usable records of known animals."""
        o = self.o
        names = [*o.covariates, *([o.time_col] if o.time_col and o.time_col not in o.covariates else [])]
        trait = o.pheno_name or (o.pheno_pos - 1)
        rows = T.phenotypes(self.lines(o.pheno), trait, o.factors, names, o.randoms, o.id_col or None)
        used = rows.where("why is null").drop("why", "f").withColumnRenamed("line", "rec")
        why = {r["why"]: r["n"] for r in rows.where("why is not null").groupBy("why").agg(F.count(F.lit(1)).alias("n")).collect()}
        LOG.info("records dropped: %s; of unknown animals: %s", why or "none", joins.unknown_count(used, ids))
        from kinforge.tables import written

        return written(joins.known_records(used, ids), "records")

    # variances

    def start(self, names: list[str]) -> dict[str, float] | None:
        """Given variances in order of precedence: a file's, the given ones, none."""
        o = self.o
        if o.variances:
            u, e = T.variances(self.lines(o.variances))
            return {n: u for n in names} | {"e": e}
        if len(o.priors) >= 2:
            given = o.priors[:-1] + [o.priors[-2]] * max(0, len(names) - len(o.priors) + 1)
            return dict(zip(names, given, strict=False)) | {"e": o.priors[-1]}
        return None

    def estimate(self, model: MixedModel, start: dict[str, float] | None, k: dict[str, np.ndarray]) -> tuple[dict[str, float], dict[str, float] | None]:
        """Variances by the chosen mode, on dense matrices within the cap; records' levels are read as columns."""
        columns = design.columns_of(model.records, model.factors, model.covariates)
        levels = [c.level for c in model.components]
        x = [c.alias(f"x{i}") for i, c in enumerate(design.wide_columns(columns))]
        pdf = model.records.orderBy("rec").select("y", *x, *[F.col(c).alias(f"l{i}") for i, c in enumerate(levels)]).toPandas()
        y, x = pdf["y"].to_numpy(float), pdf[[f"x{i}" for i in range(len(columns))]].to_numpy(float)
        z, ks, names = [], [], [c.name for c in model.components]
        for i, c in enumerate(model.components):
            at = pdf[f"l{i}"].to_numpy(float)
            one = np.zeros((len(y), c.size))
            rows = np.flatnonzero(~np.isnan(at))
            one[rows, at[rows].astype(int)] = 1.0
            z.append(one)
            ks.append(k.get(c.name, np.eye(c.size)))
        first = [start[n] for n in [*names, "e"]] if start else None
        mode, g = self.o.vce_mode, V.covariances(z, ks)
        tol, rounds = self.o.vce_tol, self.o.vce_rounds
        if mode in ("ai", "vmatrix", "stcg"):
            out = V.ai_reml(y, x, g, first, tol, rounds)
        elif mode == "em":
            out = V.em_reml(y, x, z, ks, first, tol, rounds)
        elif mode == "emai":
            out = V.emai_reml(y, x, z, ks, first, tol, rounds)
        elif mode == "hi":
            out = V.hi_reml(y, x, z, ks, tol, rounds) if len(g) == 1 else V.ai_reml(y, x, g, first, tol, rounds)
        elif mode == "fdiff":
            out = V.difference_reml(y, x, g, first)
        elif len(g) != 1:
            LOG.warning("mode %s is for one component; average information instead", mode)
            out = V.ai_reml(y, x, g, first, tol, rounds)
        elif mode == "he":
            out = V.haseman_elston(y, V.full_rank(x), g[0])
        elif mode == "mc":
            out = V.mc_em(y, x, g[0], first)
        else:
            out = V.spectral(y, x, g[0])
        if not out.get("converged", True):
            LOG.warning("variances have not converged after %s rounds", out["rounds"])
        se = dict(zip([*names, "e"], map(float, out["se"]), strict=True)) if "se" in out and self.o.se else None
        return dict(zip([*names, "e"], map(float, out["s2"]), strict=True)), se

    # tasks

    def run(self) -> None:
        o = self.o
        if not o.out:
            raise ValueError("missing --out")
        {"qc": self.qc, "sblup": self.sblup, "pred": self.pred, "relationship": self.relationship, "multi": self.multi_trait, "rrm": self.regression}.get(o.task, self.blup)()

    def qc(self) -> None:
        o, g = self.o, self.genotypes()
        quality = G.snp_quality(g.packed)
        passing = G.passing_snps(quality, o.geno, o.maf, o.max_maf, o.hwe)
        snps = sinks.snp_qc_table(g.variants, quality, passing)
        samples = sinks.sample_qc_table(g.samples, G.sample_quality(g.packed), o.mind)
        sinks.write_table(snps, f"{o.out}.qc.snp", ("_snp",))
        sinks.write_table(samples, f"{o.out}.qc.id", ("_sample",))
        sinks.write_table(snps.where("PASS = 1").select("SNP", "_snp"), f"{o.out}.keep.snp", ("_snp",), header=False)
        sinks.write_table(samples.where("PASS = 1").select("FID", "IID", "_sample"), f"{o.out}.keep.id", ("_sample",), header=False)

    def sblup(self) -> None:
        o, g = self.o, self.genotypes()
        beta = G.aligned_effects(g.variants, T.summary_statistics(self.lines(o.sumstat)).withColumnRenamed("snp", "id"))
        effects = G.block_shrinkage(g.packed, beta, g.n, g.m, o.h2, o.window)
        sinks.write_table(sinks.sblup_table(g.variants, effects), f"{o.out}.sblup.eff", ("_snp",))

    def pred(self) -> None:
        o, g = self.o, self.genotypes()
        beta = G.aligned_effects(g.variants, T.summary_statistics(self.lines(o.score)).withColumnRenamed("snp", "id"))
        sinks.write_table(sinks.profile_table(g.samples, G.scores(g.packed, g.samples, beta)), f"{o.out}.profile", ("_sample",))

    def export(self, m: DataFrame, ids: DataFrame, n: int, name: str) -> None:
        o = self.o
        if o.output_format == "bin":
            sinks.write_packed(m, n, f"{o.out}.{name}.bin", o.magic.encode() or M.PACKED_MAGIC, M.PACKED_HEADER.pack(1, n, 1, 1, 1, 1))
        else:
            sinks.write_table(sinks.matrix_table(m), f"{o.out}.{name}.txt", ("i", "j"), header=False)
        sinks.write_table(ids.select("id", F.col("idx").alias("_idx")), f"{o.out}.{name}.id", ("_idx",), header=False)

    def relationship(self) -> None:
        o = self.o
        typed = bool(o.bfile or o.pfile or o.bgen)
        kind = o.relationship or ("h" if o.ped and typed else "g" if typed else "a")
        if o.ibc and o.ped:
            ped, f = self.pedigree()
            sinks.write_table(sinks.inbreeding_table(ped, f), f"{o.out}.ibc", ("_idx",))
        if kind == "a":
            ped, d = self.pedigree()
            n, ids = ped.count(), ped.select("id", "idx")
            if o.make_matrix:
                self.export(P.relationship(ped, d), ids, n, "PA")
            if o.make_inv or o.add_inv:
                self.export(P.a_inverse(ped, d), ids, n, "PAinv")
            return
        if kind == "h":
            k = self.kinship()
            if o.make_inv or o.add_inv:
                self.export(k.kinv, k.ids, k.n, "HAinv")
            if o.make_matrix:
                ped, d, found, g = self._h
                at = found.where("idx is not null").orderBy("sample").toPandas()
                whole = self.dense(P.relationship(ped, d), k.n)
                own = self.dense(g, g.where("i = j").count())[np.ix_(at["sample"], at["sample"])]
                self.export(self.rows(coo.h_matrix(whole, own, at["idx"].to_numpy(np.int64))), k.ids, k.n, "HA")
            return
        g = self.genotypes()
        self._sample_ids = ids = g.samples.select(F.col("iid").alias("id"), F.col("sample").alias("idx"))
        m = self.g_rows(g)
        if o.make_matrix:
            self.export(m, ids, g.n, "GA")
        if o.make_inv or o.add_inv:
            self.export(self.inverse(m, g.n), ids, g.n, "GAinv")
        for on, inverse, name, of in ((o.dom, o.dom_inv, "GD", lambda: self.g_rows(g, G.DOMINANCE)), (o.epi, o.epi_inv, "GE", lambda: coo.hadamard_square(m))):
            if on or inverse:
                other = of()
                self.export(other, ids, g.n, name)
                if inverse:
                    self.export(self.inverse(other, g.n), ids, g.n, f"{name}inv")
        if o.rc:
            sinks.write_table(sinks.coefficients_table(m, ids), f"{o.out}.rc", ("_i", "_j"))
        if o.pca:
            pcs = G.principal_components(self.dense(m, g.n), o.npc) if g.n <= 6000 else G.principal_components_of(g.packed, g.n, o.npc, o.code_method)
            sinks.write_table(sinks.components_table(self.spark, pcs, ids), f"{o.out}.pca", ("_idx",))
        if o.allele_freq:
            sinks.write_table(sinks.frequency_table(g.variants, G.usable_frequencies(G.frequencies(g.packed))), f"{o.out}.frq", ("_snp",))
        if o.homo or o.hete:
            quality = G.sample_quality(G.filtered(g.packed))
            for on, what, name in ((o.homo, "homo", "homo"), (o.hete, "het", "hete")):
                if on:
                    sinks.write_table(sinks.rate_table(g.samples, quality, what), f"{o.out}.{name}", ("_sample",))

    def model_of(self, records: DataFrame, k: Kinship) -> tuple[MixedModel, dict[str, np.ndarray]]:
        """The model with its components in order (main effect, dominance, epistasis, permanent, maternal, others), and what
        dense K they have."""
        o, dense = self.o, {}
        model = MixedModel(records).fixed(o.factors, o.covariates).random(k.label, "idx", k.n, k.kinv)
        if o.dom or o.epi:
            g = self.genotypes()
            for on, name, of in ((o.dom, "GD", lambda: self.g_rows(g, G.DOMINANCE)), (o.epi, "GE", lambda: coo.hadamard_square(self.g_rows(g)))):
                if on:
                    model.records = model.records.withColumn(f"{name}_id", F.col("idx"))
                    m = of()
                    dense[name] = self.dense(m, g.n)
                    model.random(name, f"{name}_id", g.n, self.rows(G.psd_inverse(dense[name], o.ridge)))
        if o.pe:
            model.records = model.records.withColumn("Pe_id", F.col("idx"))
            model.random("Pe", "Pe_id", k.n)
        if o.mat:
            ped, _ = self.pedigree()
            model.records = P.to_dams(model.records, ped, "idx", "Mat_id")
            model.random("Mat", "Mat_id", k.n, k.kinv)
        for name in o.randoms:
            levels = P.first_appearance(model.records.select(name, "rec"), name, "rec").withColumnRenamed("level", f"{name}_id")
            model.records = model.records.join(levels, name)
            model.random(name, f"{name}_id", levels.count())
        from kinforge.tables import written

        model.records = written(model.records, "model-records")
        return model, dense

    def main_k(self, k: Kinship) -> np.ndarray:
        return self.dense(k.k, k.n) if k.k is not None else G.psd_inverse(self.dense(k.kinv, k.n))

    def blup(self) -> Solution:
        o, k = self.o, self.kinship()
        model, dense = self.model_of(self.records(k.ids), k)
        names = [c.name for c in model.components]
        s2, se = self.start(names), None
        if o.vce or s2 is None and not o.skip_vce:
            dense |= {k.label: self.main_k(k)} | ({"Mat": self.main_k(k)} if o.mat else {})
            s2, se = self.estimate(model, s2, dense)
            sinks.write_table(sinks.vars_table(self.spark, s2, se, o.pe), f"{o.out}.vars")
        s2 = s2 or {n: 1.0 for n in [*names, "e"]}
        gone = [n for n in names if s2[n] <= 1e-9]
        model.components = [c for c in model.components if c.name not in gone]
        s = model.solve(s2, dense_cap=0 if o.matrix_free else 6000, tol=o.pcg_tol, rounds=o.pcg_rounds, errors=o.se and not o.matrix_free)
        if not o.se:
            s.se = None
        sinks.write_table(sinks.beta_table(self.spark, s), f"{o.out}.beta")
        if s.se is not None and len(s.names) > 1:
            sinks.write_table(sinks.anova_table(self.spark, s), f"{o.out}.anova")
        self.write_effects(model, s, k)
        if o.snp_effect and k.label == "GA":
            g = self.genotypes()
            u = self.spark.createDataFrame([(i, float(v)) for i, v in enumerate(s.u["GA"])], "j long, x double")
            q = k.kinv.join(u, "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v")).withColumnRenamed("i", "sample")
            sinks.write_table(sinks.snp_effect_table(g.variants, G.frequencies(g.packed), G.snp_effects(g.packed, q, g.n)), f"{o.out}.snp_eff", ("_snp",))
        return s

    def write_effects(self, model: MixedModel, s: Solution, k: Kinship) -> None:
        order = (F.col("_first").asc_nulls_last(), "ID")
        sinks.write_table(sinks.rand_table(model, s, k.ids, "idx"), f"{self.o.out}.rand", order)
        sinks.write_table(sinks.obsrand_table(model, s, k.ids, "idx"), f"{self.o.out}.obsrand", ("Record",))

    def regression(self) -> RR.Regression:
        o, k = self.o, self.kinship()
        records, time = self.records(k.ids), o.time_col or (o.covariates[0] if o.covariates else "")
        if not time:
            raise ValueError("random regression needs a time covariate")
        names = ["u"] + (["pe"] if o.pe else [])
        s2 = self.start(names)
        if s2 is None and not o.skip_vce or o.vce:
            model = MixedModel(records).fixed(o.factors, o.covariates).random("u", "idx", k.n, k.kinv)
            if o.pe:
                model.records = model.records.withColumn("pe_id", F.col("idx"))
                model.random("pe", "pe_id", k.n)
            s2, _ = self.estimate(model, s2, {"u": self.main_k(k)})
        s2 = {n: max(v, 1e-6) for n, v in (s2 or {n: 1.0 for n in [*names, "e"]}).items()}
        fit = RR.fit(records, time, k.n, k.kinv, s2, o.order, o.factors, o.covariates, "idx", o.pe, errors=o.se)
        ids = k.ids.select(F.col("id").alias("ID"), "idx")
        sinks.write_lines(f"{o.out}.rrm.meta.txt", [f"order\t{o.order}", f"time\t{time}", f"times\t{len(fit.times)}", *[f"var_{n}\t{v:.6g}" for n, v in s2.items()]])
        effects = ["u"] + (["pe"] if o.pe else [])
        coefficients = [fit.coefficients(e).join(ids, "idx").select(F.lit(e).alias("Effect"), "ID", *[f"c{i}" for i in range(o.order + 1)], F.col("idx").alias("_idx")) for e in effects]
        curves = [fit.curves(e).join(ids, "idx").select(F.lit(e).alias("Effect"), "ID", "t", "value", F.col("idx").alias("_idx")) for e in effects]
        both = lambda parts: parts[0] if len(parts) == 1 else parts[0].union(parts[1])
        sinks.write_table(both(coefficients), f"{o.out}.rrcoef", ("Effect", "_idx"))
        sinks.write_table(both([fit.covariance(e) for e in effects]), f"{o.out}.rrk", ("effect", "row", "col"))
        sinks.write_table(both(curves), f"{o.out}.rrcurve", ("Effect", "_idx", "t"))
        sinks.write_table(sinks.beta_table(self.spark, fit.solution), f"{o.out}.beta")
        return fit

    def multi_trait(self) -> dict:
        o, k = self.o, self.kinship()
        traits = [t for t in re.split(r"[,\s]+", o.pheno_name) if t] or None
        rows = T.multi_trait(self.lines(o.pheno), traits, o.id_col or None, o.factors, o.covariates)
        traits = traits or [c for c in rows.columns if c not in ("id", *o.factors, *o.covariates)]
        own = joins.complete_cases(joins.aligned_records(rows, k.ids), traits)
        columns = design.columns_of(own, o.factors, o.covariates)
        x = [c.alias(f"x{i}") for i, c in enumerate(design.wide_columns(columns))]
        pdf = own.orderBy("idx").select("id", "idx", *traits, *x).toPandas()
        at = pdf["idx"].to_numpy(np.int64)
        y, x = pdf[traits].to_numpy(float), pdf[[f"x{i}" for i in range(len(columns))]].to_numpy(float)
        whole = self.main_k(k)
        out = V.multi_trait_reml(y, x, whole[np.ix_(at, at)], rounds=max(500, 25 * o.vce_rounds))
        beta, u = V.multi_trait_solve(y, x, whole[np.ix_(at, at)], out["vg"], out["ve"])
        sinks.write_table(sinks.trait_vars_table(self.spark, out["vg"], out["ve"]), f"{o.out}.mv.vars")
        cols = ", ".join(f"`{t}` double" for t in traits)
        sinks.write_table(sinks.local(self.spark, [(c[0], *map(float, b)) for c, b in zip(columns, beta, strict=True)], f"Effect string, {cols}"), f"{o.out}.beta")
        sinks.write_table(sinks.local(self.spark, [(i, *map(float, v)) for i, v in zip(pdf["id"], u, strict=True)], f"ID string, {cols}"), f"{o.out}.rand")
        return out
