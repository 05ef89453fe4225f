"""All registered queries of the engine, by name, with their SQL where SQL can express them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge import dense_sql as D
from kinforge import lenses as L
from kinforge.functions.stats import with_hwe
from kinforge import sinks
from kinforge.operators import coo, design, joins
from kinforge.operators import genotypes as G
from kinforge.operators import moments as MO
from kinforge.operators import pedigree as P
from kinforge.plans import genomic as GP
from kinforge.plans import random_regression as RR
from kinforge.plans import variance as V
from kinforge.plans.mixed_model import MixedModel, effects_table
from kinforge.sources import text as T
from kinforge.tables import written

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def _long(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("long") for c in cols})


def _ainv(spark: SparkSession, sf_dir: str) -> DataFrame:
    ped = L.pedigree(spark, sf_dir)
    d = ped.select("idx", (1 - F.when(F.col("sire").isNull(), 0.0).otherwise(0.5)).alias("d"))
    return P.a_inverse(ped, d)


# --- scans and records

_TEXT = """SELECT o_orderkey AS line, 'c' || o_custkey AS id, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice END AS y, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderpriority END AS f FROM orders"""


def _pheno_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phenotype text with missing tokens, header first."""
    o = L.table(spark, sf_dir, "orders")
    y = F.when(F.col("o_orderkey") % 11 == 0, "NA").otherwise(F.col("o_totalprice").cast("string"))
    f = F.when(F.col("o_orderkey") % 13 == 0, ".").otherwise(F.col("o_orderpriority"))
    body = o.select(F.col("o_orderkey").alias("line"), F.concat_ws(",", F.concat(F.lit("c"), F.col("o_custkey")), y, f).alias("text"))
    return spark.createDataFrame([(-1, "id,trait,prio")], body.schema).union(body)


@query(f"SELECT line, id, y, f AS prio FROM ({_TEXT}) WHERE y IS NOT NULL AND f IS NOT NULL")
def pheno_clean(spark, sf_dir):
    rows = T.phenotypes(_pheno_lines(spark, sf_dir), "trait", ["prio"])
    return rows.where("why is null").select("line", "id", "y", "prio")


@query(f"""SELECT CASE WHEN y IS NULL THEN 'trait' WHEN f IS NULL THEN 'missing prio' ELSE 'used' END AS why, count(*)::BIGINT AS n FROM ({_TEXT}) GROUP BY 1""")
def pheno_drop_counts(spark, sf_dir):
    rows = T.phenotypes(_pheno_lines(spark, sf_dir), "trait", ["prio"])
    return rows.groupBy(F.coalesce("why", F.lit("used")).alias("why")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey AS id, max_by(o_totalprice, o_orderkey) AS y, max(o_orderkey) AS line FROM orders GROUP BY 1")
def last_row_dedupe(spark, sf_dir):
    rows = L.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("y"), F.col("o_orderkey").alias("line"))
    return T.last_row_per_id(rows)


@query("""WITH c AS (SELECT n_nationkey AS i, n_regionkey AS j, (n_nationkey + 1) * 0.5 AS v FROM nation WHERE n_nationkey > n_regionkey OR n_nationkey = n_regionkey)
SELECT i::BIGINT AS i, j::BIGINT AS j, v::DOUBLE AS v FROM c UNION ALL SELECT j, i, v FROM c WHERE i <> j""")
def rel_symmetrise(spark, sf_dir):
    cells = L.table(spark, sf_dir, "nation").where("n_nationkey >= n_regionkey")
    lines = cells.select(F.col("n_nationkey").cast("long").alias("line"), F.concat_ws(" ", "n_nationkey", "n_regionkey", (F.col("n_nationkey") + 1) * 0.5).alias("text"))
    return T.triplets(lines)


@query("SELECT rec, 'mu' AS name, 1.0::DOUBLE AS val FROM (SELECT o_orderkey AS rec FROM orders) UNION ALL SELECT o_orderkey, 'priority_' || o_orderpriority, 1.0 FROM orders WHERE o_orderpriority <> (SELECT min(o_orderpriority) FROM orders) UNION ALL SELECT o_orderkey, 'mon', month(o_orderdate)::DOUBLE FROM orders")
def design_long(spark, sf_dir):
    return design.long_design(L.phenotypes(spark, sf_dir), ["priority"], ["mon"])


@query("SELECT level, (row_number() OVER (ORDER BY level) - 1)::INT AS place FROM (SELECT DISTINCT o_orderpriority AS level FROM orders)")
def fixed_levels(spark, sf_dir):
    return design.factor_levels(L.phenotypes(spark, sf_dir), "priority")


_LONG = f"""WITH {L.PHENO}, d AS (SELECT rec, 'mu' AS name, 1.0 AS val FROM pheno UNION ALL SELECT rec, 'priority_' || priority, 1.0 FROM pheno
  WHERE priority <> (SELECT min(priority) FROM pheno) UNION ALL SELECT rec, 'mon', mon FROM pheno)"""


@query(f"{_LONG} SELECT a.name AS c1, b.name AS c2, round(sum(a.val * b.val)::DOUBLE, 6) AS v FROM d a JOIN d b USING (rec) GROUP BY 1, 2")
def xtx(spark, sf_dir):
    return MO.cross_products(L.phenotypes(spark, sf_dir), ["priority"], ["mon"]).withColumn("v", r6(F.col("v")))


@query(f"{_LONG} SELECT name, round(sum(val * y)::DOUBLE, 2) AS v FROM d JOIN pheno USING (rec) GROUP BY 1")
def xty(spark, sf_dir):
    return MO.right_side(L.phenotypes(spark, sf_dir), ["priority"], ["mon"]).withColumn("v", r6(F.col("v"), 2))


@query("SELECT o_custkey AS i, count(*)::BIGINT AS v FROM orders GROUP BY 1")
def ztz_diag(spark, sf_dir):
    return MO.level_counts(L.phenotypes(spark, sf_dir))


_LEG = f"""WITH {L.PHENO}, t AS (SELECT rec, id, 2 * (mon - min(mon) OVER ()) / (max(mon) OVER () - min(mon) OVER ()) - 1 AS x FROM pheno),
  b AS (SELECT rec, id, sqrt(0.5::DOUBLE) AS p0, sqrt(1.5::DOUBLE) * x AS p1, sqrt(2.5::DOUBLE) * (3 * x * x - 1) / 2 AS p2 FROM t)"""


def _basis(spark, sf_dir):
    rows = L.phenotypes(spark, sf_dir)
    low, high = rows.agg(F.min("mon"), F.max("mon")).first()
    return rows.select("rec", "id", *[c.alias(f"p{k}") for k, c in enumerate(design.legendre(F.col("mon"), low, high, 2))])


@query(f"{_LEG} SELECT rec, round(p0, 6) AS p0, round(p1, 6) + 0.0 AS p1, round(p2, 6) + 0.0 AS p2 FROM b")
def legendre_basis(spark, sf_dir):
    return _basis(spark, sf_dir).select("rec", *[r6(F.col(f"p{k}")).alias(f"p{k}") for k in range(3)])


@query(f"{_LEG} SELECT id, round(sum(p0 * p1), 5) + 0.0 AS c01, round(sum(p1 * p1), 5) + 0.0 AS c11, round(sum(p1 * p2), 5) + 0.0 AS c12 FROM b GROUP BY id")
def rr_xtx(spark, sf_dir):
    pair = lambda a, b: r6(F.sum(F.col(f"p{a}") * F.col(f"p{b}")), 5).alias(f"c{a}{b}")
    return _basis(spark, sf_dir).groupBy("id").agg(pair(0, 1), pair(1, 1), pair(1, 2))


@query(f"""WITH {L.PHENO}, m AS (SELECT id, avg(y) AS mean, count(*) AS n, var_pop(y) AS v FROM pheno GROUP BY id)
SELECT count(*)::BIGINT AS subjects, round(sum(n * v) / sum(n - 1), 4) AS within, round(var_samp(mean), 4) AS between_means FROM m""")
def subject_anova(spark, sf_dir):
    return MO.subject_variances(L.phenotypes(spark, sf_dir)).withColumns({c: r6(F.col(c), 4) for c in ("within", "between_means")})


_RESIDUAL = f"""WITH {L.PHENO}, r AS (SELECT rec, id, y, avg(y) OVER (PARTITION BY priority) AS fit FROM pheno)"""


@query(f"{_RESIDUAL} SELECT rec, round(fit, 5) + 0.0 AS fitted, round(y - fit, 5) + 0.0 AS residual FROM r")
def obs_residuals(spark, sf_dir):
    """Residuals of the factor's least-squares fit: its solution comes from X'X and X'y."""
    rows = L.phenotypes(spark, sf_dir)
    columns = design.columns_of(rows, ["priority"], [])
    xx, xy, _, _ = design.cross_wide(rows, columns)
    beta = np.linalg.solve(xx, xy)
    fit = sum((x * float(b) for x, b in zip(design.wide_columns(columns), beta, strict=True)), F.lit(0.0))
    return rows.select("rec", r6(fit, 5).alias("fitted"), r6(F.col("y") - fit, 5).alias("residual"))


@query(f"{_RESIDUAL} SELECT id, round(avg(y - fit), 5) + 0.0 AS residual, count(*)::BIGINT AS n_obs FROM r GROUP BY id")
def rand_means(spark, sf_dir):
    rows = L.phenotypes(spark, sf_dir)
    means = rows.groupBy("priority").agg(F.avg("y").alias("fit"))
    return MO.subject_means(rows.join(means, "priority"), {"residual": F.col("y") - F.col("fit")}).withColumn("residual", r6(F.col("residual"), 5))


# --- pedigree

_AINV = f"""WITH {L.PED}, d AS (SELECT *, CASE WHEN sire IS NULL THEN 1.0 ELSE 0.5 END AS d FROM ped),
  t AS (SELECT idx AS k, idx, 1.0 AS c, d FROM d UNION ALL SELECT sire, idx, -0.5, d FROM d WHERE sire IS NOT NULL UNION ALL SELECT dam, idx, -0.5, d FROM d WHERE dam IS NOT NULL),
  ainv AS (SELECT a.k AS i, b.k AS j, sum(a.c * b.c / a.d)::DOUBLE AS v FROM t a JOIN t b USING (idx) GROUP BY 1, 2)"""


@query(f"{_AINV} SELECT i, j, round(v, 6) + 0.0 AS v FROM ainv WHERE abs(v) > 1e-12")
def ainv_triplets(spark, sf_dir):
    return _ainv(spark, sf_dir).withColumn("v", r6(F.col("v")))


@query(f"{_AINV} SELECT i, round(sum(v * c_acctbal), 4) + 0.0 AS v FROM ainv JOIN customer ON j = c_custkey GROUP BY i")
def ainv_spmv(spark, sf_dir):
    x = L.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("v"))
    return coo.multiply(_ainv(spark, sf_dir), x).withColumn("v", r6(F.col("v"), 4))


@query(f"WITH RECURSIVE {L.DEEP}, g AS (SELECT idx, 0 AS generation FROM deep WHERE sire IS NULL UNION SELECT d.idx, g.generation + 1 FROM deep d JOIN g ON d.sire = g.idx OR d.dam = g.idx) SELECT idx, max(generation)::INT AS generation FROM g GROUP BY idx")
def ped_generation(spark, sf_dir):
    return P.generations(L.deep_pedigree(spark, sf_dir))


_PATHS = f"""WITH RECURSIVE {L.DEEP}, par AS (SELECT idx, sire AS p FROM deep WHERE sire IS NOT NULL UNION ALL SELECT idx, dam FROM deep WHERE dam IS NOT NULL),
  w AS (SELECT idx, idx AS ancestor, 1.0::DOUBLE AS weight FROM deep UNION ALL SELECT w.idx, par.p, w.weight * 0.5 FROM w JOIN par ON w.ancestor = par.idx),
  l AS (SELECT idx, ancestor, sum(weight) AS weight FROM w GROUP BY 1, 2)"""


@query(f"{_PATHS} SELECT idx, ancestor, round(weight, 9) AS weight FROM l")
def ped_paths(spark, sf_dir):
    return P.ancestor_paths(L.deep_pedigree(spark, sf_dir)).withColumn("weight", r6(F.col("weight"), 9))


@query(D.INBREEDING)
def ped_inbreeding(spark, sf_dir):
    return P.inbreeding(L.deep_pedigree(spark, sf_dir)).select("idx", r6(F.col("f"), 8).alias("f"), r6(F.col("d"), 8).alias("d"))


@query(f"""WITH {L.PED} SELECT a.idx AS i, b.idx AS j, (CASE WHEN a.idx = b.idx THEN 1.0 WHEN a.sire = b.sire THEN 0.5 WHEN a.sire = b.idx OR a.dam = b.idx OR b.sire = a.idx OR b.dam = a.idx THEN 0.5 END)::DOUBLE AS v
FROM ped a JOIN ped b ON a.idx = b.idx OR a.sire = b.sire OR a.sire = b.idx OR a.dam = b.idx OR b.sire = a.idx OR b.dam = a.idx""")
def ped_relationship(spark, sf_dir):
    ped = L.pedigree(spark, sf_dir)
    d = ped.select("idx", F.when(F.col("sire").isNull(), 1.0).otherwise(0.5).alias("d"))
    return P.relationship(ped, d).withColumn("v", r6(F.col("v")))


@query("""SELECT o_custkey AS id, (row_number() OVER (ORDER BY min(o_orderkey), o_custkey) - 1)::BIGINT AS level FROM orders GROUP BY 1""")
def random_levels(spark, sf_dir):
    return P.first_appearance(L.phenotypes(spark, sf_dir).select("id", "rec"), "id", "rec")


# --- genotypes


@query(f"WITH {L.GENO} SELECT snp, count_if(dosage = 0)::BIGINT AS n0, count_if(dosage = 1)::BIGINT AS n1, count_if(dosage = 2)::BIGINT AS n2, count_if(dosage IS NULL)::BIGINT AS missing, count(*)::BIGINT AS n FROM geno GROUP BY snp")
def geno_counts(spark, sf_dir):
    return G.snp_counts(L.genotypes(spark, sf_dir))


_QUALITY = f"""WITH {L.GENO}, q AS (SELECT snp, count_if(dosage = 0) AS n0, count_if(dosage = 1) AS n1, count(dosage) AS valid, count(*) AS n FROM geno GROUP BY snp),
  m AS (SELECT snp, coalesce(least((2 * n0 + n1) / nullif(2.0 * valid, 0), 1 - (2 * n0 + n1) / nullif(2.0 * valid, 0)), 0) AS maf, (n - valid) / n::DOUBLE AS miss_rate FROM q)"""


@query(f"{_QUALITY} SELECT snp, round(maf, 6)::DOUBLE AS maf, round(miss_rate, 6)::DOUBLE AS miss_rate FROM m")
def snp_maf_miss(spark, sf_dir):
    return G.snp_quality(L.genotypes(spark, sf_dir)).select("snp", r6(F.col("maf")).alias("maf"), r6(F.col("miss_rate")).alias("miss_rate"))


@query(f"{_QUALITY} SELECT snp FROM m WHERE miss_rate <= 0.26 AND maf BETWEEN 0.3 AND 0.5")
def qc_pass_snp(spark, sf_dir):
    return G.passing_snps(G.snp_quality(L.genotypes(spark, sf_dir)), geno=0.26, maf=0.3, max_maf=0.5).select("snp")


_SAMPLES = f"""WITH {L.GENO}, s AS (SELECT sample, count(*)::BIGINT AS n, count(dosage)::BIGINT AS valid, count_if(dosage = 1)::BIGINT AS het, count_if(dosage IN (0, 2))::BIGINT AS homo FROM geno GROUP BY sample)"""


@query(f"{_SAMPLES} SELECT sample, n, valid, round(1 - valid / n::DOUBLE, 6) AS miss_rate, round(het / valid::DOUBLE, 6) AS het_rate FROM s")
def ind_qc(spark, sf_dir):
    return G.sample_quality(L.genotypes(spark, sf_dir)).select("sample", "n", "valid", r6(F.col("miss_rate")).alias("miss_rate"), r6(F.col("het_rate")).alias("het_rate"))


@query(f"{_SAMPLES} SELECT sample FROM s WHERE 1 - valid / n::DOUBLE <= 0.25")
def qc_pass_ind(spark, sf_dir):
    return G.passing_samples(G.sample_quality(L.genotypes(spark, sf_dir)), 0.25).select("sample")


@query(f"WITH {L.GENO}, {L.FREQ} SELECT sample, count_if(dosage IN (0, 2))::BIGINT AS homo, count_if(dosage = 1)::BIGINT AS het, count(dosage)::BIGINT AS valid FROM geno JOIN ok USING (snp) GROUP BY sample")
def homo_hete(spark, sf_dir):
    g = L.genotypes(spark, sf_dir)
    return G.sample_quality(G.filtered(g)).select("sample", "homo", "het", "valid")


@query(f"WITH {L.GENO}, {L.FREQ} SELECT snp, round(p, 6) AS p, round(var, 6) + 0.0 AS var, valid::BIGINT AS valid FROM freq")
def allele_freq(spark, sf_dir):
    return G.frequencies(L.genotypes(spark, sf_dir)).select("snp", r6(F.col("p")).alias("p"), r6(F.col("var")).alias("var"), "valid")


@query(f"WITH {L.GENO}, {L.FREQ} SELECT round(sum(2 * p * (1 - p)), 4) AS sum2pq, round(sum(4 * p * p * (1 - p) * (1 - p)), 4) AS sum4p2q2, round(sum(var), 4) AS sumvar, count(*)::BIGINT AS m FROM ok")
def sum2pq(spark, sf_dir):
    s = G.sum_2pq(G.usable_frequencies(G.frequencies(L.genotypes(spark, sf_dir))))
    return s.select(*[r6(F.col(c), 4).alias(c) for c in ("sum2pq", "sum4p2q2", "sumvar")], "m")


@query(f"WITH {L.GENO}, {L.FREQ}, own AS (SELECT snp, s_nationkey AS grp, avg(dosage) / 2 AS p FROM geno JOIN supplier ON sample = s_suppkey GROUP BY 1, 2) SELECT own.snp, grp, round(coalesce(own.p, freq.p), 6) AS p FROM own JOIN freq USING (snp)")
def pop_freq(spark, sf_dir):
    groups = L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_nationkey").alias("grp"))
    return G.group_frequencies(L.genotypes(spark, sf_dir), groups).withColumn("p", r6(F.col("p")))


def _grm_sql(z: str, by: str, post: str = "v") -> str:
    return f"""WITH {L.GENO}, {L.FREQ}, z AS (SELECT snp, sample, coalesce(CASE WHEN dosage IS NOT NULL THEN {z} END, 0) AS z FROM geno JOIN ok USING (snp)),
  raw AS (SELECT a.sample AS i, b.sample AS j, sum(a.z * b.z) AS v FROM z a JOIN z b ON a.snp = b.snp AND a.sample >= b.sample GROUP BY 1, 2),
  g AS (SELECT i, j, v / ({by}) AS v FROM raw) SELECT i, j, round({post}, 6) + 0.0 AS v FROM g"""


def _grm(method: int):
    def run(spark, sf_dir):
        n = L.table(spark, sf_dir, "supplier").count()
        return G.relationship(L.genotypes(spark, sf_dir), n, method).withColumn("v", r6(F.col("v")))

    return run


_OK = "(SELECT {} FROM ok)"
for _name, _method, _z, _by in (
    ("grm_vanraden", G.VANRADEN, "dosage - 2 * p", _OK.format("sum(2 * p * (1 - p))")),
    ("grm_zeng", G.ZENG, "CASE dosage WHEN 2 THEN 1 - p WHEN 1 THEN 1 - 2 * p ELSE -p END", "(SELECT avg(v) FROM raw WHERE i = j)"),
    ("grm_yang", G.YANG, "(dosage - 2 * p) / sqrt(2 * p * (1 - p))", _OK.format("count(*)")),
    ("grm_dominance", G.DOMINANCE, "CASE dosage WHEN 2 THEN -2 * (1 - p) * (1 - p) WHEN 1 THEN 2 * p * (1 - p) ELSE -2 * p * p END", _OK.format("sum(4 * p * p * (1 - p) * (1 - p))")),
    ("grm_truevar", G.TRUE_VARIANCE, "(dosage - 2 * p) / sqrt(var)", _OK.format("sum(var)")),
):
    QUERIES[_name], ORACLE[_name] = _grm(_method), _grm_sql(_z, _by)


@query(_grm_sql("dosage - 2 * p", _OK.format("sum(2 * p * (1 - p))")) + " WHERE abs(v) >= 0.05")
def grm_sparse(spark, sf_dir):
    n = L.table(spark, sf_dir, "supplier").count()
    return coo.sparse(G.relationship(L.genotypes(spark, sf_dir), n)).withColumn("v", r6(F.col("v")))


@query(_grm_sql("dosage - 2 * p", _OK.format("sum(2 * p * (1 - p))"), "v * v"))
def grm_epistasis(spark, sf_dir):
    n = L.table(spark, sf_dir, "supplier").count()
    return coo.hadamard_square(G.relationship(L.genotypes(spark, sf_dir), n)).withColumn("v", r6(F.col("v")))


@query(_grm_sql("dosage - 2 * p", _OK.format("sum(2 * p * (1 - p))")).replace("SELECT i, j, round(v, 6) + 0.0 AS v FROM g", "SELECT round(avg(v) FILTER (i = j), 6) AS diagonal, round(avg(v) FILTER (i <> j), 6) + 0.0 AS off FROM g"))
def grm_tune_means(spark, sf_dir):
    g = G.relationship(L.genotypes(spark, sf_dir), L.n_samples(spark, sf_dir))
    return MO.mean_entries(g).withColumns({c: r6(F.col(c)) for c in ("diagonal", "off")})


@query(_grm_sql("dosage - 2 * p", _OK.format("sum(2 * p * (1 - p))")).replace("SELECT i, j, round(v, 6) + 0.0 AS v FROM g", "SELECT a.s_name AS id1, b.s_name AS id2, round(v, 6) + 0.0 AS rc FROM g JOIN supplier a ON a.s_suppkey = i JOIN supplier b ON b.s_suppkey = j"))
def rel_coef(spark, sf_dir):
    ids = L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"), F.col("s_name").alias("id"))
    g = G.relationship(L.genotypes(spark, sf_dir), L.n_samples(spark, sf_dir))
    return sinks.coefficients_table(g, ids).select("id1", "id2", r6(F.col("rc")).alias("rc"))


def _a22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships of the genotyped customers (those with a supplier's number)."""
    ped = L.pedigree(spark, sf_dir)
    d = ped.select("idx", (1 - F.when(F.col("sire").isNull(), 0.0).otherwise(0.5)).alias("d"))
    return P.relationship(ped, d, L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx")))


def _g_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.full(written(G.relationship(L.genotypes(spark, sf_dir), L.n_samples(spark, sf_dir)), "relationships"))


@query(D.TUNED)
def grm_tuned(spark, sf_dir):
    """G tuned to unrelated animals and blended with them."""
    eye = coo.identity(spark, L.n_samples(spark, sf_dir))
    return G.blend_rows(_g_rows(spark, sf_dir), eye).withColumn("v", r6(F.col("v")))


@query(D.h_inverse(_AINV))
def hinv_union(spark, sf_dir):
    """H^-1: A^-1 plus the inverse of G, tuned to and blended with A22, less that of A22, at the genotyped animals."""
    n, a22 = L.n_samples(spark, sf_dir), written(_a22(spark, sf_dir), "a22")
    parts = [coo.by_one_task(m, n, G.definite_inverse) for m in (G.blend_rows(_g_rows(spark, sf_dir), a22), a22)]
    return coo.h_inverse(_ainv(spark, sf_dir), *parts).withColumn("v", r6(F.col("v"), 5)).where("v <> 0")


@query(f"WITH {L.EFFECTS} SELECT snp, round(beta, 8) + 0.0 AS beta FROM beta")
def sumstat_align(spark, sf_dir):
    return G.aligned_effects(L.variants(spark, sf_dir), L.effects(spark, sf_dir)).select("snp", r6(F.col("beta"), 8).alias("beta"))


@query(f"WITH {L.GENO}, {L.EFFECTS} SELECT s_suppkey AS sample, round(coalesce(sum(dosage * beta), 0), 6) + 0.0 AS score FROM supplier LEFT JOIN (SELECT * FROM geno JOIN beta USING (snp) WHERE dosage IS NOT NULL) x ON x.sample = s_suppkey GROUP BY 1")
def score_prs(spark, sf_dir):
    effects = G.aligned_effects(L.variants(spark, sf_dir), L.effects(spark, sf_dir))
    samples = L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"))
    return G.scores(L.genotypes(spark, sf_dir), samples, effects).withColumn("score", r6(F.col("score")))


@query(f"""WITH {L.GENO}, {L.FREQ}, z AS (SELECT snp, sample, coalesce(dosage - 2 * p, 0) AS z FROM geno JOIN ok USING (snp))
SELECT snp, round(sum(z * s_acctbal) / (SELECT sum(2 * p * (1 - p)) FROM ok), 4) + 0.0 AS effect FROM z JOIN supplier ON sample = s_suppkey GROUP BY snp""")
def snp_backsolve(spark, sf_dir):
    q = L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_acctbal").alias("v"))
    return G.snp_effects(L.genotypes(spark, sf_dir), q, L.n_samples(spark, sf_dir)).withColumn("effect", r6(F.col("effect"), 4))


@query(f"""WITH {L.GENO}, {L.FREQ}, z AS (SELECT snp, sample, coalesce((dosage - 2 * p) / sqrt(var * valid / (SELECT count(*) FROM supplier)), 0) AS z FROM geno JOIN freq USING (snp) WHERE var > 0)
SELECT a.snp AS snp1, b.snp AS snp2, round(sum(a.z * b.z) / (SELECT count(*) FROM supplier), 6) + 0.0 AS r FROM z a JOIN z b ON a.sample = b.sample AND a.snp // 20 = b.snp // 20 AND a.snp < b.snp GROUP BY 1, 2""")
def ld_block_corr(spark, sf_dir):
    return G.block_correlations(L.genotypes(spark, sf_dir, 20), 20, adjacent=True).withColumn("r", r6(F.col("r")))


@query("SELECT s_suppkey AS sample, s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS core FROM supplier")
def apy_core_flag(spark, sf_dir):
    """A core file that names the suppliers of a region's nations."""
    samples = L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_name").alias("id"), "s_nationkey")
    nations = L.table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    named = samples.join(nations, "s_nationkey", "left_semi").select(F.col("sample").alias("line"), F.concat(F.lit("  "), "id").alias("text"))
    return T.core_flags(samples, named).select("sample", "core")


@query(f"""WITH {L.PHENO}, {L.PED}, m AS (SELECT id, avg(y) AS y FROM pheno GROUP BY id), r AS (SELECT id, y - avg(y) OVER () AS r FROM m),
  rel AS (SELECT a.idx AS i, b.idx AS j, 0.5 AS v FROM ped a JOIN ped b ON a.idx > b.idx AND (a.sire = b.sire OR a.sire = b.idx OR a.dam = b.idx))
SELECT round(sum(v * v)::DOUBLE, 4) AS aa, round(sum(v * x.r * y.r), 2) + 0.0 AS ayy, count(*)::BIGINT AS pairs FROM rel JOIN r x ON x.id = i JOIN r y ON y.id = j""")
def he_moments(spark, sf_dir):
    """Haseman-Elston sums over related pairs j < i with records: only the matrix's entries are joined."""
    out = MO.relative_moments(ped_relationship(spark, sf_dir), MO.centred_means(L.phenotypes(spark, sf_dir)))
    return out.select(r6(F.col("aa"), 4).alias("aa"), r6(F.col("ayy"), 2).alias("ayy"), "pairs")


@query(D.HWE)
def hwe_exact(spark, sf_dir):
    counts = G.snp_counts(L.genotypes(spark, sf_dir))
    return with_hwe(counts, "n0", "n1", "n2").select("snp", "n0", "n1", "n2", r6(F.col("hwe_p")).alias("hwe_p"))


# --- models


def _model(spark, sf_dir) -> tuple[MixedModel, int]:
    n = L.table(spark, sf_dir, "customer").agg(F.max("c_custkey") + 1).first()[0]
    model = MixedModel(L.phenotypes(spark, sf_dir)).fixed(["priority"], ["mon"])
    return model.random("u", "id", n, _ainv(spark, sf_dir)), n


def _vector(spark, name: str, values) -> DataFrame:
    return effects_table(spark, {name: values})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pedigree BLUP with fixed variances: (idx, u)."""
    model, _ = _model(spark, sf_dir)
    return model.solve({"u": 0.4, "e": 0.6}).table(spark, {"u": "u"})


@query(D.PBLUP)
def pblup_fixed(spark, sf_dir):
    return flagship(spark, sf_dir).withColumn("u", r6(F.col("u"), 5))


@query(D.REPEAT)
def repeatability(spark, sf_dir):
    """Additive and permanent effects of repeated records; one row per record."""
    model, n = _model(spark, sf_dir)
    model.records = model.records.withColumn("pe_id", F.col("id"))
    model.random("pe", "pe_id", n)
    out = model.fitted(model.solve({"u": 0.4, "pe": 0.2, "e": 0.6}, dense_cap=4000))
    return out.select("rec", "y", *[r6(F.col(c), 4).alias(c) for c in ("fixed", "u", "pe", "fitted", "residual")])


def _genomic(spark, sf_dir, method: int = G.VANRADEN) -> tuple[np.ndarray, np.ndarray]:
    """Dense G within the cap, and one phenotype a sample."""
    n = L.table(spark, sf_dir, "supplier").count()
    g = coo.dense(G.full(G.relationship(L.genotypes(spark, sf_dir), n, method)), n)
    y = L.table(spark, sf_dir, "supplier").orderBy("s_suppkey").select((F.col("s_acctbal") / 1000).alias("y")).toPandas()["y"].to_numpy()
    return g, y


#: Samples whose matrix and its inverse the driver may hold.
DENSE_SAMPLES = 2000


def _matrix_free(spark, sf_dir):
    n = L.n_samples(spark, sf_dir)
    product = GP.GenomicProduct(L.genotypes(spark, sf_dir), n)
    d, one = product.diagonal(), np.ones(n)
    dg = d.mean()
    og = (float(one @ product(one)[:, 0]) - d.sum()) / (n * (n - 1))
    b = 1 / (dg - og)
    tuned = lambda v: 0.95 * (b * product(v) + (1 - b * dg) * v.reshape(n, -1).sum(0)) + 0.05 * v.reshape(n, -1)
    tuned.diagonal = lambda: 0.95 * (b * d + 1 - b * dg) + 0.05
    y = L.table(spark, sf_dir, "supplier").orderBy("s_suppkey").select((F.col("s_acctbal") / 1000).alias("y")).toPandas()["y"].to_numpy()
    out = GP.gblup(tuned, y, np.ones((n, 1)), (0.4, 0.6))
    product.close()
    return _vector(spark, "u", out["u"]).withColumn("u", r6(F.col("u"), 5))


@query(D.GBLUP)
def gblup_fixed(spark, sf_dir):
    """By the inverse of G; beyond ``DENSE_SAMPLES`` by products, the same solution without the matrix on the driver."""
    if L.n_samples(spark, sf_dir) > DENSE_SAMPLES:
        return _matrix_free(spark, sf_dir)
    g, _ = _genomic(spark, sf_dir)
    rows = L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rec"), F.col("s_suppkey").alias("id"), (F.col("s_acctbal") / 1000).alias("y"))
    from kinforge.sources.matrices import coo as to_rows

    model = MixedModel(rows).random("u", "id", len(g), to_rows(spark, G.psd_inverse(G.tune(g, np.eye(len(g))))))
    return _vector(spark, "u", model.solve({"u": 0.4, "e": 0.6}).u["u"]).withColumn("u", r6(F.col("u"), 5))


@query(f"""WITH {L.PHENO}, {L.PED} SELECT dam, count(*) AS n, round(sum(y), 6) AS sum_y, count(DISTINCT id) AS n_offspring
  FROM pheno JOIN ped ON id = idx WHERE dam IS NOT NULL GROUP BY dam""")
def maternal_remap(spark, sf_dir):
    """Right-hand side and diagonal of the maternal effect: records go to their animal's dam."""
    rows = P.to_dams(L.phenotypes(spark, sf_dir), L.pedigree(spark, sf_dir)).where("dam_id is not null")
    # an animal has one dam: records are summed by animal before the dams are
    by_id = rows.groupBy("dam_id", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    return by_id.groupBy(F.col("dam_id").alias("dam")).agg(F.sum("n").alias("n"), F.round(F.sum("y"), 6).alias("sum_y"), F.count(F.lit(1)).alias("n_offspring"))


@query(D.MATERNAL)
def maternal_blup(spark, sf_dir):
    """Direct and maternal effects over one A inverse: (idx, u, mat)."""
    model, n = _model(spark, sf_dir)
    model.records = P.to_dams(model.records, L.pedigree(spark, sf_dir))
    model.random("mat", "dam_id", n, _ainv(spark, sf_dir))
    return model.solve({"u": 0.4, "mat": 0.1, "e": 0.5}).table(spark, {"u": "u", "mat": "mat"}).withColumns({c: r6(F.col(c), 5) for c in ("u", "mat")})


@query(D.SINGLE_STEP)
def single_step(spark, sf_dir):
    """Single-step BLUP: A inverse plus the inverse of tuned, blended G less that of A22, for genotyped animals."""
    from kinforge.sources.matrices import coo as to_rows

    g, _ = _genomic(spark, sf_dir)
    ped = L.pedigree(spark, sf_dir)
    d = ped.select("idx", (1 - F.when(F.col("sire").isNull(), 0.0).otherwise(0.5)).alias("d"))
    typed = L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("idx"))
    a22 = coo.dense(P.relationship(ped, d, typed), len(g))
    block = G.psd_inverse(G.tune(g, a22)) - G.psd_inverse(a22)
    n = L.table(spark, sf_dir, "customer").agg(F.max("c_custkey") + 1).first()[0]
    model = MixedModel(L.phenotypes(spark, sf_dir)).fixed(["priority"], ["mon"])
    model.random("u", "id", n, coo.add(P.a_inverse(ped, d), to_rows(spark, block)))
    return model.solve({"u": 0.4, "e": 0.6}).table(spark, {"u": "u"}).withColumn("u", r6(F.col("u"), 5))


@query()
def vce_ai(spark, sf_dir):
    g, y = _genomic(spark, sf_dir)
    x = np.ones((len(y), 1))
    out = V.ai_reml(y, x, [G.tune(g, np.eye(len(g)))])
    return spark.createDataFrame([("u", float(out["s2"][0])), ("e", float(out["s2"][1]))], "item string, var double")


@query()
def vce_spectral(spark, sf_dir):
    g, y = _genomic(spark, sf_dir)
    out = V.spectral(y, np.ones((len(y), 1)), G.tune(g, np.eye(len(g))))
    return spark.createDataFrame([("u", float(out["s2"][0])), ("e", float(out["s2"][1]))], "item string, var double")


@query()
def vce_em(spark, sf_dir):
    g, y = _genomic(spark, sf_dir)
    out = V.em_reml(y, np.ones((len(y), 1)), [np.eye(len(y))], [G.tune(g, np.eye(len(g)))])
    return spark.createDataFrame([("u", float(out["s2"][0])), ("e", float(out["s2"][1]))], "item string, var double")


@query(D.HE)
def vce_he(spark, sf_dir):
    g, y = _genomic(spark, sf_dir)
    out = V.haseman_elston(y, np.ones((len(y), 1)), g)
    return spark.createDataFrame([("u", float(out["s2"][0])), ("e", float(out["s2"][1]))], "item string, var double").withColumn("var", r6(F.col("var")))


@query()
def multitrait(spark, sf_dir):
    g, y = _genomic(spark, sf_dir)
    two = np.column_stack([y, np.roll(y, 3) * 0.5 + y * 0.3])
    x, k = np.ones((len(y), 1)), G.tune(g, np.eye(len(g)))
    out = V.multi_trait_reml(two, x, k)
    if not out["converged"]:
        raise ArithmeticError(f"multi-trait variances not converged after {out['rounds']} rounds")
    _, u = V.multi_trait_solve(two, x, k, out["vg"], out["ve"])
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(u)], "idx long, trait1 double, trait2 double")


@query(D.APY)
def apy_inverse(spark, sf_dir):
    n = L.n_samples(spark, sf_dir)
    g = written(G.blend_rows(_g_rows(spark, sf_dir), coo.identity(spark, n)), "blended")
    return G.apy_blocks(g, spark.range(n // 2).toDF("i")).withColumn("v", r6(F.col("v"), 5))


@query()
def pca(spark, sf_dir):
    g, _ = _genomic(spark, sf_dir)
    pcs = G.principal_components(g, 3)
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(pcs)], "sample long, pc1 double, pc2 double, pc3 double")


@query(D.SBLUP)
def sblup(spark, sf_dir):
    g = L.genotypes(spark, sf_dir, 1000)
    n, m = L.table(spark, sf_dir, "supplier").count(), L.table(spark, sf_dir, "part").count()
    beta = G.aligned_effects(L.variants(spark, sf_dir), L.effects(spark, sf_dir))
    return G.block_shrinkage(g, beta, n, m, 0.3, adjacent=True).withColumn("effect", r6(F.col("effect"), 9))


def _regression(spark, sf_dir, permanent: bool = False, refine: bool = True):
    n = L.table(spark, sf_dir, "customer").agg(F.max("c_custkey") + 1).first()[0]
    return RR.fit(L.phenotypes(spark, sf_dir), "mon", n, _ainv(spark, sf_dir), {"u": 0.4, "pe": 0.2, "e": 0.6}, 1, ["priority"], [], permanent=permanent, refine=refine, errors=False)


@query(D.RR_CURVE)
def rrm_curve(spark, sf_dir):
    """Random regression of order 1 on month, refined by K: (idx, t, value) over the grid of times."""
    return _regression(spark, sf_dir).curves().withColumn("value", r6(F.col("value"), 2))


@query(D.RR_COEF)
def rrm_coef(spark, sf_dir):
    return _regression(spark, sf_dir).coefficients().withColumns({c: r6(F.col(c), 3) for c in ("c0", "c1")})


@query(D.RR_K)
def rrm_k(spark, sf_dir):
    """Covariances of additive and permanent coefficients: those of the first solution, so there is no second."""
    fit = _regression(spark, sf_dir, True, refine=False)
    return fit.covariance("u").union(fit.covariance("pe")).withColumn("v", r6(F.col("v"), 5))


@query(D.GBLUP)
def gblup_matrix_free(spark, sf_dir):
    """The same model without the matrix: G tuned to and blended with I is a product with ZZ' and two constants."""
    return _matrix_free(spark, sf_dir)


@query()
def vce_stochastic(spark, sf_dir):
    """Average information with stochastic traces, over passes of the genotypes."""
    n = L.n_samples(spark, sf_dir)
    product = GP.GenomicProduct(L.genotypes(spark, sf_dir), n)
    y = L.table(spark, sf_dir, "supplier").orderBy("s_suppkey").select((F.col("s_acctbal") / 1000).alias("y")).toPandas()["y"].to_numpy()
    s2 = GP.stochastic_reml(product, y, np.ones((n, 1)), rounds=8)["s2"]
    product.close()
    return spark.createDataFrame([("u", float(s2[0])), ("e", float(s2[1]))], "item string, var double")


@query("""SELECT s_suppkey AS sample, row_number() OVER (ORDER BY s_suppkey) <= 50 AS core FROM supplier""")
def apy_first_core(spark, sf_dir):
    return MO.first_core(L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample")), 50)


# --- files, joins by id, result tables

@query("""WITH p AS (SELECT c_custkey AS line, 'a' || (1500000 - c_custkey) AS id, CASE WHEN c_custkey >= 4 THEN 'a' || (1500000 - c_custkey // 2) END AS dam, CASE WHEN c_custkey >= 4 THEN 'a' || (1500000 - c_custkey // 3) END AS sire FROM customer),
  seen AS (SELECT line, 0 AS place, id FROM p UNION ALL SELECT line, 1, dam FROM p WHERE dam IS NOT NULL UNION ALL SELECT line, 2, sire FROM p WHERE sire IS NOT NULL),
  n AS (SELECT id, (row_number() OVER (ORDER BY min(line * 3 + place)) - 1)::BIGINT AS idx FROM seen GROUP BY id)
SELECT n.idx, n.id, s.idx AS sire, d.idx AS dam FROM n LEFT JOIN p USING (id) LEFT JOIN n s ON s.id = p.sire LEFT JOIN n d ON d.id = p.dam""")
def ped_scan(spark, sf_dir):
    """A pedigree file of customers in reverse numbers: ids numbered by first appearance over all three columns."""
    k = F.col("c_custkey")
    name = lambda c: F.concat(F.lit("a"), F.lit(1500000) - c)
    parts = [name(k), F.when(k >= 4, name(F.floor(k / 2))).otherwise("0"), F.when(k >= 4, name(F.floor(k / 3))).otherwise("NA")]
    body = L.table(spark, sf_dir, "customer").select(k.alias("line"), F.concat_ws(" ", *parts).alias("text"))
    return T.pedigree(spark.createDataFrame([(-1, "id dam sire")], body.schema).union(body))


@query(f"""SELECT line, id, y, f AS prio, c_custkey::BIGINT AS idx FROM ({_TEXT}) JOIN customer ON id = 'c' || c_custkey WHERE y IS NOT NULL AND f IS NOT NULL AND c_custkey % 3 <> 0""")
def pheno_known(spark, sf_dir):
    """Usable records of the animals that the matrix has."""
    ids = L.table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_custkey").alias("idx"))
    rows = T.phenotypes(_pheno_lines(spark, sf_dir), "trait", ["prio"]).where("why is null")
    return joins.known_records(rows.select("line", "id", "y", "prio"), ids).select("line", "id", "y", "prio", "idx")


_TRAITS = """WITH t AS (SELECT o_orderkey AS line, o_custkey AS k, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS t1, o_totalprice / 2 AS t2 FROM orders WHERE o_orderkey % 5 <> 0),
  l AS (SELECT 'c' || k AS id, max_by(coalesce(t1, -1), line) AS t1, max_by(t2, line) AS t2 FROM t GROUP BY k)"""


def _trait_lines(spark, sf_dir):
    o = L.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat_ws(" ", F.concat(F.lit("c"), "o_custkey"), F.when(k % 7 == 0, "NA").otherwise(F.col("o_totalprice").cast("string")), (F.col("o_totalprice") / 2).cast("string"), F.when(k % 5 == 0, ".").otherwise("1"))
    body = o.select(k.alias("line"), text.alias("text"))
    return spark.createDataFrame([(-1, "IID t1 t2 x")], body.schema).union(body)


@query(f"{_TRAITS} SELECT id, nullif(t1, -1) AS t1, t2 FROM l")
def multi_trait_scan(spark, sf_dir):
    """Last row of each animal among those that have the covariate; traits may be missing."""
    return T.multi_trait(_trait_lines(spark, sf_dir), ["t1", "t2"], covariates=["x"]).drop("x")


@query(f"{_TRAITS} SELECT 'c' || c_custkey AS id, c_custkey::BIGINT AS idx, nullif(t1, -1) AS t1, t2 FROM customer LEFT JOIN l ON id = 'c' || c_custkey WHERE c_custkey % 2 = 0")
def aligned_traits(spark, sf_dir):
    """A row for every animal of the matrix, with its traits or nulls."""
    ids = L.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_custkey").alias("idx"))
    return joins.aligned_records(T.multi_trait(_trait_lines(spark, sf_dir), ["t1", "t2"], covariates=["x"]).drop("x"), ids)


@query(f"{_TRAITS} SELECT id, t1, t2 FROM l WHERE t1 >= 0")
def complete_traits(spark, sf_dir):
    return joins.complete_cases(T.multi_trait(_trait_lines(spark, sf_dir), ["t1", "t2"], covariates=["x"]).drop("x"), ["t1", "t2"])


@query("SELECT s_suppkey AS sample, 'a' || s_suppkey AS id, c_custkey::BIGINT AS idx FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 1) ON s_suppkey = c_custkey")
def typed_in_pedigree(spark, sf_dir):
    samples = L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), F.concat(F.lit("a"), "s_suppkey").alias("id"))
    ped = L.table(spark, sf_dir, "customer").where("c_custkey % 4 <> 1").select(F.concat(F.lit("a"), "c_custkey").alias("id"), F.col("c_custkey").alias("idx"))
    return joins.in_pedigree(samples, ped)


_ALIAS = "s AS (SELECT s_suppkey AS sample, 'f' || s_nationkey AS fid, 'i' || (s_suppkey % 80) AS iid FROM supplier)"


def _families(spark, sf_dir):
    return L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), F.concat(F.lit("f"), "s_nationkey").alias("fid"), F.concat(F.lit("i"), F.col("s_suppkey") % 80).alias("iid"))


@query(f"WITH {_ALIAS} SELECT fid || ':' || iid AS id, sample FROM s UNION ALL SELECT iid, min(sample) FROM s GROUP BY iid HAVING count(*) = 1")
def sample_aliases(spark, sf_dir):
    return joins.sample_aliases(_families(spark, sf_dir)).select("id", "sample")


_POP = """pop AS (SELECT r_regionkey AS line, 'i' || (r_regionkey * 3) AS id, r_name AS pop FROM region UNION ALL SELECT 100 + n_nationkey, 'f' || n_nationkey || ':i' || n_nationkey, n_name FROM nation),
  nr AS (SELECT pop, row_number() OVER (ORDER BY min(line), pop) AS grp FROM pop GROUP BY pop), own AS (SELECT id, min_by(pop, line) AS pop FROM pop GROUP BY id)"""


@query(f"WITH {_ALIAS}, {_POP} SELECT sample, coalesce(a.grp, b.grp, 0)::BIGINT AS grp FROM s LEFT JOIN (SELECT id, grp FROM own JOIN nr USING (pop)) a ON a.id = iid LEFT JOIN (SELECT id, grp FROM own JOIN nr USING (pop)) b ON b.id = fid || ':' || iid")
def pop_classes(spark, sf_dir):
    """Classes of samples by IID, else by FID and IID, else 0."""
    one = L.table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("line"), F.concat(F.lit("i"), F.col("r_regionkey") * 3, F.lit("\t"), F.regexp_replace("r_name", " ", "_")).alias("text"))
    two = L.table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("line"), F.concat_ws(" ", F.concat(F.lit("f"), "n_nationkey"), F.concat(F.lit("i"), "n_nationkey"), F.regexp_replace("n_name", " ", "_")).alias("text"))
    source = one.union(two)
    return G.classes(_families(spark, sf_dir), T.populations(source))


@query(f"""WITH {L.GENO}, {L.FREQ}, grp AS (SELECT s_suppkey AS sample, s_nationkey % 3 AS grp FROM supplier), x AS (SELECT geno.*, grp FROM geno JOIN ok USING (snp) JOIN grp USING (sample)),
  c AS (SELECT snp, grp, avg(dosage) AS mean FROM x GROUP BY 1, 2), z AS (SELECT snp, sample, coalesce(dosage - coalesce(mean, 2 * p), 0) AS z FROM x JOIN c USING (snp, grp) JOIN ok USING (snp)),
  raw AS (SELECT a.sample AS i, b.sample AS j, sum(a.z * b.z) AS v FROM z a JOIN z b ON a.snp = b.snp AND a.sample >= b.sample GROUP BY 1, 2),
  sc AS (SELECT sample, grp, avg(v) OVER (PARTITION BY grp) AS s FROM raw JOIN grp ON i = sample WHERE i = j)
SELECT i, j, round(v / sqrt(a.s * b.s), 6) + 0.0 AS v FROM raw JOIN sc a ON a.sample = i JOIN sc b ON b.sample = j""")
def grm_population(spark, sf_dir):
    groups = L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), (F.col("s_nationkey") % 3).alias("grp"))
    return G.population_relationship(L.genotypes(spark, sf_dir), groups, L.n_samples(spark, sf_dir)).withColumn("v", r6(F.col("v")))


_WEIGHT = "w AS (SELECT p_partkey AS snp, p_size / 10.0 AS weight FROM part WHERE p_size % 4 <> 0)"


@query(f"WITH {L.GENO}, {L.FREQ}, {_WEIGHT} SELECT round(sum(weight * 2 * p * (1 - p)), 4) AS sum2pq, round(sum(weight * var), 4) AS sumvar, round(sum(weight), 4)::DOUBLE AS sumw, count(*)::BIGINT AS m FROM ok JOIN w USING (snp)")
def weighted_sum2pq(spark, sf_dir):
    """Sums with weights of a file; variants without one take no part."""
    part = L.table(spark, sf_dir, "part").where("p_size % 4 <> 0")
    source = part.select(F.col("p_partkey").alias("line"), F.concat_ws(" ", F.concat(F.lit("rs"), "p_partkey"), F.col("p_size") / 10).alias("text"))
    weights = L.variants(spark, sf_dir).join(T.snp_weights(source), "id").select("snp", "weight")
    s = G.sum_2pq(G.usable_frequencies(G.frequencies(L.genotypes(spark, sf_dir))), weights)
    return s.select(*[r6(F.col(c), 4).alias(c) for c in ("sum2pq", "sumvar", "sumw")], "m")


@query(f"""WITH {L.GENO}, {L.FREQ}, {_WEIGHT}, z AS (SELECT snp, sample, coalesce(dosage - 2 * p, 0) * sqrt(weight) AS z FROM geno JOIN ok USING (snp) JOIN w USING (snp)),
  raw AS (SELECT a.sample AS i, b.sample AS j, sum(a.z * b.z) AS v FROM z a JOIN z b ON a.snp = b.snp AND a.sample >= b.sample GROUP BY 1, 2)
SELECT i, j, round(v / (SELECT sum(weight * 2 * p * (1 - p)) FROM ok JOIN w USING (snp)), 6) + 0.0 AS v FROM raw""")
def grm_weighted(spark, sf_dir):
    weights = L.table(spark, sf_dir, "part").where("p_size % 4 <> 0").select(F.col("p_partkey").alias("snp"), (F.col("p_size") / 10).alias("weight"))
    return G.relationship(L.genotypes(spark, sf_dir), L.n_samples(spark, sf_dir), weights=weights).withColumn("v", r6(F.col("v")))


@query("SELECT n_nationkey::BIGINT AS i, n_regionkey::BIGINT AS j, CASE WHEN n_nationkey <> n_regionkey THEN -1.0 ELSE 1.0 END::DOUBLE AS v FROM nation")
def sign_repair(spark, sf_dir):
    """An inverse whose off-diagonals have the wrong sign."""
    cells = L.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").cast("long").alias("j"), F.lit(1.0).alias("v"))
    return coo.repair_signs(cells)


@query("SELECT c_custkey::BIGINT AS idx, CASE WHEN c_custkey % 3 = 1 THEN c_custkey // 2 END::BIGINT AS sire, CASE WHEN c_custkey // 4 <> c_custkey THEN c_custkey // 4 END::BIGINT AS dam FROM customer")
def ped_parents(spark, sf_dir):
    """Parents that are not animals of the pedigree, or the animal itself, are unknown."""
    k = F.col("c_custkey")
    sire = F.when(k % 3 == 0, -5).when(k % 3 == 1, F.floor(k / 2)).otherwise(k + 10_000_000)
    return joins.normalised_parents(L.table(spark, sf_dir, "customer").select(k.alias("idx"), sire.alias("sire"), F.floor(k / 4).alias("dam")))


@query("SELECT (row_number() OVER (ORDER BY c_custkey DESC) - 1)::BIGINT AS idx, c_name AS id FROM customer WHERE c_custkey % 2 = 0")
def id_list(spark, sf_dir):
    """Trimmed lines that aren't blank, numbered in order."""
    k = F.col("c_custkey")
    return T.id_list(L.table(spark, sf_dir, "customer").select((-k).alias("line"), F.when(k % 2 == 0, F.concat(F.lit("  "), "c_name", F.lit(" "))).otherwise("   ").alias("text")))


@query("""WITH l AS (SELECT p_partkey AS line, 'rs' || (p_partkey % 500) AS snp, CASE WHEN p_size % 9 <> 0 THEN p_retailprice / 7 END AS beta FROM part)
SELECT snp, 'A' AS a1, 'C' AS a2, max_by(beta, line) AS beta FROM l WHERE beta IS NOT NULL GROUP BY snp""")
def sumstat_scan(spark, sf_dir):
    part = L.table(spark, sf_dir, "part")
    beta = F.when(F.col("p_size") % 9 == 0, "x").otherwise((F.col("p_retailprice") / 7).cast("string"))
    body = part.select(F.col("p_partkey").alias("line"), F.concat_ws("\t", F.lit("c"), F.lit("a"), beta, F.concat(F.lit("rs"), F.col("p_partkey") % 500)).alias("text"))
    return T.summary_statistics(spark.createDataFrame([(-1, "OTHER_ALLELE\tEFFECT_ALLELE\tEFFECT\tVARIANT_ID")], body.schema).union(body))


@query("""WITH n AS (SELECT r_regionkey AS i FROM region) SELECT a.i::BIGINT AS i, b.i::BIGINT AS j, (CASE WHEN a.i = b.i THEN 2 ELSE 1.0 / (1 + a.i + b.i) END)::DOUBLE AS v FROM n a, n b""")
def dense_matrix_scan(spark, sf_dir):
    """A square text matrix: its lines are rows."""
    i = F.col("r_regionkey")
    cell = lambda j: F.when(i == j, 2.0).otherwise(1.0 / (1 + i + j)).cast("string")
    rows = L.table(spark, sf_dir, "region").select(i.cast("long").alias("line"), F.concat_ws(" ", *[cell(j) for j in range(5)]).alias("text"))
    return T.triplets(rows)


@query(f"""{_AINV}, ids AS (SELECT c_custkey AS old, c_custkey // 2 AS new FROM customer WHERE c_custkey % 2 = 0) SELECT a.new::BIGINT AS i, b.new::BIGINT AS j, round(v, 6) AS v FROM ainv JOIN ids a ON a.old = i JOIN ids b ON b.old = j WHERE abs(v) > 1e-12""")
def matrix_remap(spark, sf_dir):
    k = F.col("c_custkey")
    ids = L.table(spark, sf_dir, "customer").where(k % 2 == 0).select(k.alias("old"), F.floor(k / 2).alias("new"))
    return coo.remap(_ainv(spark, sf_dir), ids).withColumn("v", r6(F.col("v")))


@query("""WITH m AS (SELECT n_nationkey AS i, n_regionkey AS j, CASE WHEN n_nationkey = n_regionkey THEN 0.0 ELSE n_nationkey::DOUBLE END AS v FROM nation),
  h AS (SELECT i, j, v / 2 AS v FROM m UNION ALL SELECT j, i, v / 2 FROM m) SELECT i::BIGINT AS i, j::BIGINT AS j, CASE WHEN i = j AND abs(sum(v)) < 1e-14 THEN 1e-10 ELSE sum(v) END AS v FROM h GROUP BY i, j""")
def matrix_mirrored(spark, sf_dir):
    i, j = F.col("n_nationkey").cast("long"), F.col("n_regionkey").cast("long")
    return coo.mirrored(L.table(spark, sf_dir, "nation").select(i.alias("i"), j.alias("j"), F.when(i == j, 0.0).otherwise(i.cast("double")).alias("v")))


@query(f"WITH {L.PED} SELECT (idx + 1)::BIGINT AS i, (j + 1)::BIGINT AS j, v FROM (SELECT idx, idx AS j, 1.0::DOUBLE AS v FROM ped UNION ALL SELECT idx, sire, 0.5 FROM ped WHERE sire IS NOT NULL UNION ALL SELECT idx, dam, 0.5 FROM ped WHERE dam IS NOT NULL UNION ALL SELECT a.idx, b.idx, 0.5 FROM ped a JOIN ped b ON a.sire = b.sire AND a.idx > b.idx)")
def matrix_lower(spark, sf_dir):
    """The exported lower triangle of A, numbered from 1."""
    return sinks.matrix_table(ped_relationship(spark, sf_dir))


_VARIANT = "v AS (SELECT p_partkey AS snp, '1' AS CHR, 'rs' || p_partkey AS SNP_ID FROM part)"


def _variants(spark, sf_dir):
    return L.variants(spark, sf_dir).select("snp", "id", F.lit("1").alias("chrom"), F.col("snp").alias("pos"), "a1", "a2")


def _samples(spark, sf_dir):
    return L.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sample"), F.col("s_name").alias("iid"), F.lit("0").alias("fid"))


@query(f"""{D.HWE.rsplit("SELECT snp, n0", 1)[0]}, hw AS (SELECT snp, p FROM c JOIN p USING (n0, n1, n2)), {_QUALITY[_QUALITY.index("q AS"):]}
SELECT '1' AS CHR, 'rs' || snp AS SNP, 'A' AS A1, 'C' AS A2, n0 AS HOM1, n1 AS HET, n2 AS HOM2, round(miss_rate, 6) AS MISS, round(maf, 6) AS MAF, round(hw.p, 6) AS HWE_P, (miss_rate <= 0.26 AND maf BETWEEN 0.3 AND 0.5)::INT AS PASS FROM m JOIN c USING (snp) JOIN hw USING (snp)""")
def qc_snp_table(spark, sf_dir):
    quality = G.snp_quality(L.genotypes(spark, sf_dir))
    out = sinks.snp_qc_table(_variants(spark, sf_dir), quality, G.passing_snps(quality, geno=0.26, maf=0.3, max_maf=0.5)).drop("_snp")
    return out.withColumns({c: r6(F.col(c)) for c in ("MISS", "MAF", "HWE_P")})


@query(f"{_SAMPLES} SELECT '0' AS FID, s_name AS IID, round(1 - valid / n::DOUBLE, 6) AS MISS_RATE, round(het / valid::DOUBLE, 6) AS HET_RATE, (1 - valid / n::DOUBLE <= 0.25)::INT AS PASS FROM s JOIN supplier ON sample = s_suppkey")
def qc_id_table(spark, sf_dir):
    out = sinks.sample_qc_table(_samples(spark, sf_dir), G.sample_quality(L.genotypes(spark, sf_dir)), 0.25).drop("_sample")
    return out.withColumns({c: r6(F.col(c)) for c in ("MISS_RATE", "HET_RATE")})


@query(f"WITH {L.GENO}, {L.FREQ} SELECT '1' AS CHR, 'rs' || snp AS SNP, 'A' AS A1, 'C' AS A2, round(p, 6) AS FREQ_A1 FROM ok")
def frq_table(spark, sf_dir):
    f = G.usable_frequencies(G.frequencies(L.genotypes(spark, sf_dir)))
    return sinks.frequency_table(_variants(spark, sf_dir), f).drop("_snp").withColumn("FREQ_A1", r6(F.col("FREQ_A1")))


@query(f"WITH {L.GENO}, {L.FREQ}, c AS (SELECT sample, count_if(dosage IN (0, 2))::BIGINT AS n, count(dosage)::BIGINT AS valid FROM geno JOIN ok USING (snp) GROUP BY sample) SELECT s_name AS ID, n AS count, valid AS TOTAL_VALID, round(n / valid::DOUBLE, 6) AS rate FROM c JOIN supplier ON sample = s_suppkey")
def homo_table(spark, sf_dir):
    out = sinks.rate_table(_samples(spark, sf_dir), G.sample_quality(G.filtered(L.genotypes(spark, sf_dir))), "homo")
    return out.drop("_sample").withColumn("rate", r6(F.col("rate")))


@query(f"WITH {L.GENO}, {L.EFFECTS}, x AS (SELECT sample, sum(dosage * beta) AS score FROM geno JOIN beta USING (snp) WHERE dosage IS NOT NULL GROUP BY sample) SELECT s_name AS ID, round(coalesce(score, 0), 6) + 0.0 AS SCORE FROM supplier LEFT JOIN x ON sample = s_suppkey")
def profile_table(spark, sf_dir):
    return sinks.profile_table(_samples(spark, sf_dir), score_prs(spark, sf_dir)).drop("_sample")


@query(f"{D.SBLUP.rsplit('SELECT snp, round', 1)[0]}, e AS (SELECT snp, (any_value(beta) - sum(z * s.v)) / any_value(c) AS effect FROM z JOIN s ON s.block = z.block AND s.i = z.sample, c GROUP BY snp) SELECT 'rs' || snp AS SNP, 'A' AS A1, 'C' AS A2, round(effect, 9) + 0.0 AS SBLUP_EFFECT FROM e")
def sblup_table(spark, sf_dir):
    return sinks.sblup_table(_variants(spark, sf_dir), sblup(spark, sf_dir)).drop("_snp")


@query(f"{D.INBREEDING.rsplit('SELECT l.idx, round', 1)[0]} SELECT c_name AS ID, round(f, 8) + 0.0 AS F FROM (SELECT l.idx, greatest(0, sum(weight * weight * a.d) - 1) AS f FROM l JOIN d a ON a.idx = l.ancestor GROUP BY l.idx) JOIN customer ON c_custkey = idx")
def ibc_table(spark, sf_dir):
    ped = L.deep_pedigree(spark, sf_dir)
    named = ped.join(L.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("id")), "idx")
    return sinks.inbreeding_table(named, P.inbreeding(ped)).drop("_idx").withColumn("F", r6(F.col("F"), 8))


@query(f"""{D.REPEAT.rsplit('SELECT rec, y', 1)[0]}, o AS (SELECT fit.id, avg(y - fixed - u - pe) AS residuals, count(*) AS n, min(rec) AS first FROM fit JOIN pheno USING (rec) JOIN blup ON idx = fit.id GROUP BY fit.id)
SELECT c_name AS ID, round(u, 4) + 0.0 AS u, round(pe, 4) + 0.0 AS pe, round(residuals, 4) + 0.0 AS residuals, coalesce(n, 0)::BIGINT AS n_obs, first AS first_rec FROM blup JOIN customer ON idx = c_custkey LEFT JOIN o ON o.id = idx""")
def rand_file(spark, sf_dir):
    """Effects and mean residuals of every animal, with what they are sorted by."""
    model, n = _model(spark, sf_dir)
    model.records = model.records.withColumn("pe_id", F.col("id"))
    model.random("pe", "pe_id", n)
    s = model.solve({"u": 0.4, "pe": 0.2, "e": 0.6}, dense_cap=4000)
    ids = L.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("idx"), F.col("c_name").alias("id"))
    out = sinks.rand_table(model, s, ids).withColumnRenamed("_first", "first_rec")
    return out.withColumns({c: r6(F.col(c), 4) for c in ("u", "pe", "residuals")})


@query(f"{D.PBLUP.rsplit('SELECT idx, round', 1)[0]} SELECT name AS Levels, round(b, 5) AS Estimation FROM b")
def beta_file(spark, sf_dir):
    model, _ = _model(spark, sf_dir)
    out = sinks.beta_table(spark, model.solve({"u": 0.4, "e": 0.6}))
    return out.select("Levels", r6(F.col("Estimation"), 5).alias("Estimation"))


@query(f"""WITH v AS ({D.HE.replace("WITH ", "WITH ", 1)}) SELECT item AS Item, var AS Var, CASE WHEN item = 'e' THEN NULL ELSE round(var / (SELECT sum(var) FROM v), 5) END AS h2 FROM v""")
def vars_file(spark, sf_dir):
    s2 = {r["item"]: r["var"] for r in vce_he(spark, sf_dir).collect()}
    out = sinks.vars_table(spark, {"u": s2["u"], "e": s2["e"]})
    return out.select("Item", "Var", F.when(~F.isnan("h2"), r6(F.col("h2"), 5)).alias("h2"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
