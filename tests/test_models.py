"""Goldens worked out by hand or from identities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinforge.functions.stats import f_tail, hwe_exact
from kinforge.operators import coo
from kinforge.operators import genotypes as G
from kinforge.operators import pedigree as P
from kinforge.plans import variance as V
from kinforge.plans.mixed_model import MixedModel, pcg
from kinforge.sources import genotypes as GS
from kinforge.sources import matrices as M
from kinforge.sources import text as T

NAN = np.nan
DOSAGE = np.array([[0, 1, 2, 1], [1, 1, 0, 2], [2, 0, 1, 1], [1, 2, 1, 0], [2, 1, 1, NAN], [0, 2, 2, 1]]).T


def lines(spark, text):
    return spark.createDataFrame(list(enumerate(text.strip("\n").split("\n"))), "line long, text string")


@pytest.fixture()
def geno(spark):
    rows = [(s, i, None if np.isnan(v) else float(v)) for s, r in enumerate(DOSAGE) for i, v in enumerate(r)]
    return spark.createDataFrame(rows, "snp long, sample long, dosage double")


def test_pedigree_blup(spark):
    ped = T.pedigree(lines(spark, "id dam sire\nid1 0 0\nid2 0 0\nid3 id1 id2\nid4 id1 id2"))
    d = P.inbreeding(ped)
    ainv = coo.dense(P.a_inverse(ped, d), 4)
    assert np.allclose(ainv, [[2, 1, -1, -1], [1, 2, -1, -1], [-1, -1, 2, 0], [-1, -1, 0, 2]])
    assert np.allclose(ainv @ coo.dense(P.relationship(ped, d), 4), np.eye(4))
    rows = spark.createDataFrame([(i, i, y) for i, y in enumerate([10.0, 12.0, 13.0, 14.0])], "rec long, id long, y double")
    model = MixedModel(rows).random("u", "id", 4, P.a_inverse(ped, d))
    s = model.solve({"u": 2.0, "e": 3.0})
    assert s.beta[0] == pytest.approx(12.071429, abs=1e-5)
    assert np.allclose(s.u["u"], [-0.4, 0.4, 0.232143, 0.482143], atol=1e-5)
    assert s.se[0] == pytest.approx(1.362770, abs=1e-5)
    fitted = {r["rec"]: r["residual"] for r in model.fitted(s).collect()}
    assert np.allclose([fitted[i] for i in range(4)], [-1.671429, -0.471429, 0.696429, 1.446429], atol=1e-5)
    _, ww, wy, first = model.equations()
    rhs = np.zeros(5)
    for r in wy.collect():
        rhs[r["i"]] = r["v"]
    x, info = pcg(model.left_side(ww, first, s.s2), rhs)
    assert info["converged"] and np.allclose(x, [*s.beta, *s.u["u"]], atol=1e-8)
    for entries in (0, 10**6):  # by the cluster's rows, and by the driver's
        other = model.solve({"u": 2.0, "e": 3.0}, dense_cap=0, driver_entries=entries)
        assert np.allclose(other.u["u"], s.u["u"]) and np.allclose(other.se, s.se) and other.converged
    with pytest.warns(UserWarning):
        assert not model.solve({"u": 2.0, "e": 3.0}, dense_cap=0, rounds=1).converged


def test_inbreeding_of_full_sib_mating(spark):
    text = "id sire dam\ns5 s3 s4\ns6 s3 s4\ns1 0 0\ns2 0 0\ns3 s1 s2\ns4 s1 s2"
    ped = T.pedigree(lines(spark, text))
    rows = ped.join(P.inbreeding(ped), "idx").join(P.generations(ped), "idx").collect()
    f = {r["id"]: (r["f"], r["d"], r["generation"]) for r in rows}
    assert f == {"s1": (0, 1, 0), "s2": (0, 1, 0), "s3": (0, 0.5, 1), "s4": (0, 0.5, 1), "s5": (0.25, 0.5, 2), "s6": (0.25, 0.5, 2)}
    a = coo.dense(P.relationship(ped, P.inbreeding(ped)), 6)
    assert np.allclose(a @ coo.dense(P.a_inverse(ped, P.inbreeding(ped)), 6), np.eye(6))


def test_genomic_relationships(spark, geno):
    counts = {r["snp"]: (r["n0"], r["n1"], r["n2"], r["missing"]) for r in G.snp_counts(geno).collect()}
    assert counts == {0: (2, 2, 2, 0), 1: (1, 3, 2, 0), 2: (1, 3, 2, 0), 3: (1, 3, 1, 1)}
    g = coo.dense(G.full(G.relationship(geno, 6)), 6)
    assert np.allclose(g[0], [0.873239, -0.478873, -0.478873, -0.140845, -0.563380, 0.788732], atol=1e-5)
    assert np.allclose(np.diag(g), [0.873239, 1.211268, 1.211268, 0.873239, 0.535211, 1.211268], atol=1e-5)
    small = coo.dense(G.full(G.cross_samples(G.coded(geno), 6, tile=4, run=2, whole=0)), 6)
    tiled = coo.dense(G.full(G.cross_samples(G.coded(geno), 6, tile=4)), 6)
    assert np.allclose(small, tiled) and np.allclose(small / G.sum_2pq(G.frequencies(geno)).first()["sum2pq"], g)
    core = np.arange(6)
    k = G.tune(g, np.eye(6))
    assert np.allclose(G.apy_inverse(k, core), np.linalg.inv(k))
    assert np.allclose(G.psd_inverse(k), np.linalg.inv(k), atol=1e-6)


def test_summary_blup(spark, geno):
    beta = spark.createDataFrame([(0, 0.10), (1, -0.05), (2, 0.08), (3, 0.02)], "snp long, beta double")
    out = G.block_shrinkage(geno, beta, 6, 4, 0.3, 4)
    effects = [r["effect"] for r in out.orderBy("snp").collect()]
    assert np.allclose(effects, [0.047060, -0.011688, 0.045798, 0.013433], atol=1e-5)
    s = G.scores(geno, spark.range(6).toDF("sample"), out.select("snp", (out["effect"]).alias("beta"))).orderBy("sample")
    assert np.allclose([r["score"] for r in s.collect()], [0.093340, 0.062238, 0.153350, 0.069482, 0.128230, 0.081652], atol=1e-5)


def test_summary_blup_query_uses_blocks_of_1000(spark, tmp_path):
    from kinforge import lenses as L
    from kinforge import registry

    spark.createDataFrame([(i,) for i in range(12)], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    parts = [(i, f"p{i}", i % 5, 900.0 + i % 37) for i in range(1100)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    x = GS.long(L.genotypes(spark, str(tmp_path))).withColumn("dosage", F.col("dosage").cast("double")).toPandas().pivot(index="sample", columns="snp", values="dosage")
    z = ((x - x.mean()) / (((x - x.mean()) ** 2).sum() / 12) ** 0.5).fillna(0)
    beta = {r["snp"]: r["beta"] for r in G.aligned_effects(L.variants(spark, str(tmp_path)), L.effects(spark, str(tmp_path))).collect()}
    want = {}
    for own in (range(1000), range(1000, 1100)):
        names = [s for s in own if s in beta and np.isfinite(z[s]).all() and z[s].any()]
        r = z[names].to_numpy().T @ z[names].to_numpy() / 12 + 1100 * 0.7 / 0.3 / 12 * np.eye(len(names))
        want |= dict(zip(names, np.linalg.solve(r, [beta[s] for s in names]), strict=True))
    got = {r["snp"]: r["effect"] for r in registry.sblup(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and np.allclose([got[s] for s in want], list(want.values()))


def test_exact_tests():
    assert hwe_exact(1, 2, 3) == pytest.approx(1)
    assert hwe_exact(5, 0, 5) == pytest.approx(0.001364, abs=1e-6)
    assert hwe_exact(10, 20, 10) == pytest.approx(1)
    assert f_tail(4.0, 1, 10) == pytest.approx(0.073388, abs=1e-5)


def test_variance_components():
    rng = np.random.default_rng(1)
    b = rng.normal(size=(80, 40))
    g = b @ b.T / 40
    x = np.ones((80, 1))
    y = rng.multivariate_normal(np.zeros(80), 0.6 * g + 0.4 * np.eye(80))
    ai, sp = V.ai_reml(y, x, [g]), V.spectral(y, x, g)
    assert ai["converged"] and np.allclose(ai["s2"], sp["s2"], rtol=1e-3)
    one = V.multi_trait_em(y[:, None], x, g, tol=1e-9, rounds=5000)
    assert np.allclose([one["vg"][0, 0], one["ve"][0, 0]], sp["s2"], rtol=2e-2)
    beta, u = V.multi_trait_solve(y[:, None], x, g, np.array([[sp["s2"][0]]]), np.array([[sp["s2"][1]]]))
    v = sp["s2"][0] * g + sp["s2"][1] * np.eye(80)
    b1 = np.linalg.solve(x.T @ np.linalg.solve(v, x), x.T @ np.linalg.solve(v, y))
    assert np.allclose(beta[:, 0], b1) and np.allclose(u[:, 0], sp["s2"][0] * g @ np.linalg.solve(v, y - x @ b1))


def test_multi_trait_fit_is_finished():
    rng = np.random.default_rng(3)
    b = rng.normal(size=(120, 40))
    g, x = b @ b.T / 40, np.ones((120, 1))
    genetic = np.linalg.cholesky(g + 1e-9 * np.eye(120)) @ rng.normal(size=(120, 2)) @ np.array([[1.0, 0.3], [0, 1]])
    inner, none = genetic + rng.normal(size=(120, 2)) * 0.5, rng.normal(size=(120, 2)) @ np.array([[1.0, 0.3], [0, 1]]) + 2

    def likelihood(y, o):
        values, e = V.projected(y, x, g)
        v = values[:, None, None] * o["vg"] + o["ve"]
        return -0.5 * (np.linalg.slogdet(v)[1].sum() + np.einsum("ni,nij,nj->", e, np.linalg.inv(v), e))

    long = V.multi_trait_em(inner, x, g, tol=1e-9, rounds=20000)
    fit = V.multi_trait_reml(inner, x, g)
    assert long["converged"] and fit["converged"] and np.allclose(fit["vg"], long["vg"], atol=1e-3) and np.allclose(fit["ve"], long["ve"], atol=1e-3)
    short = V.multi_trait_em(none, x, g, rounds=50)
    assert not short["converged"]
    fit, long = V.multi_trait_reml(none, x, g), V.multi_trait_em(none, x, g, rounds=20000)
    assert fit["converged"] and likelihood(none, fit) >= likelihood(none, long) - 1e-9 > likelihood(none, short)
    assert np.linalg.norm(fit["vg"] - long["vg"]) < 0.1 * np.linalg.norm(short["vg"] - long["vg"])


def test_multitrait_query_runs_to_the_end(monkeypatch):
    from kinforge import registry

    rng = np.random.default_rng(8)
    b, seen = rng.normal(size=(50, 25)), {}
    g, y = b @ b.T / 25, rng.normal(size=50)

    class Rows:
        def createDataFrame(self, rows, schema):
            return np.array(rows)[:, 1:]

    solve = V.multi_trait_solve
    monkeypatch.setattr(registry, "_genomic", lambda *_: (g, y))
    monkeypatch.setattr(V, "multi_trait_solve", lambda *a: seen.update(vg=a[3], ve=a[4]) or solve(*a))
    registry.multitrait(Rows(), "")
    two, k = np.column_stack([y, np.roll(y, 3) * 0.5 + y * 0.3]), G.tune(g, np.eye(50))
    long = V.multi_trait_em(two, np.ones((50, 1)), k, rounds=20000)
    assert np.allclose(seen["vg"], long["vg"], atol=2e-2) and np.allclose(seen["ve"], long["ve"], atol=2e-2)


def test_formats(spark, tmp_path):
    (tmp_path / "x.bed").write_bytes(GS.encode_bed(DOSAGE))
    (tmp_path / "x.pgen").write_bytes(GS.encode_pgen(DOSAGE))
    for rows in (GS.bed(spark, str(tmp_path / "x.bed"), 6, 4, 3), GS.pgen(spark, str(tmp_path / "x.pgen"), 6, 4, 3)):
        got = np.array([[NAN if v is None else v for v in r["dosage"]] for r in rows.orderBy("snp").collect()])
        assert np.array_equal(got, DOSAGE, equal_nan=True)
    m = np.array([[2.0, 0.5], [0.5, 1.0]])
    assert np.array_equal(M.read_binary(M.write_packed(m), 2), m)
    with pytest.raises(ValueError):
        M.read_packed(M.write_packed(m) + b"x")
    cells = T.triplets(lines(spark, "1 1 2\n2 1 0.5\n2 2 1"))
    assert np.array_equal(coo.dense(cells, 2), m)


def test_grm_files(tmp_path):
    m, counts = np.array([[1.0, 0.25], [0.25, 0.75]]), np.array([[4.0, 3.0], [3.0, 4.0]])
    M.write_grm(str(tmp_path), "x", m, counts, [("f", "a"), ("f", "b")])
    values, n, ids = M.read_grm(str(tmp_path), "x")
    assert np.array_equal(values, m) and np.array_equal(n, counts) and ids == [("f", "a"), ("f", "b")]
    (tmp_path / "x.grm.N.bin").write_bytes(b"1234")
    with pytest.raises(ValueError):
        M.read_grm(str(tmp_path), "x")


def test_maternal_and_single_step(spark):
    ped = spark.createDataFrame([(0, None, None), (1, None, None), (2, 0, 1), (3, 0, 1), (4, 2, 3)], "idx long, sire long, dam long")
    f = P.inbreeding(ped)
    a = coo.dense(P.relationship(ped, f), 5)
    some = ped.where("idx in (2, 4)")
    block = {(r["i"], r["j"]): r["v"] for r in P.relationship(ped, f, some).collect()}
    assert {k: pytest.approx(a[k]) for k in ((2, 2), (2, 4), (4, 2), (4, 4))} == block
    records = spark.createDataFrame([(0, 2, 10.0), (1, 3, 12.0), (2, 4, 9.0), (3, 1, 8.0), (4, 4, 11.0)], "rec long, id long, y double")
    ainv = P.a_inverse(ped, f)
    model = MixedModel(P.to_dams(records, ped)).random("u", "id", 5, ainv).random("mat", "dam_id", 5, ainv)
    u = model.solve({"u": 0.4, "mat": 0.1, "e": 0.5}).u
    z, m = np.zeros((5, 5)), np.zeros((5, 5))
    for r, (i, dam) in enumerate(((2, 1), (3, 1), (4, 3), (1, None), (4, 3))):
        z[r, i] = 1
        if dam is not None:
            m[r, dam] = 1
    y, one = np.array([10.0, 12, 9, 8, 11]), np.ones((5, 1))
    v = 0.4 * z @ a @ z.T + 0.1 * m @ a @ m.T + 0.5 * np.eye(5)
    rest = np.linalg.solve(v, y - one @ np.linalg.solve(one.T @ np.linalg.solve(v, one), one.T @ np.linalg.solve(v, y)))
    assert np.allclose(u["u"], 0.4 * a @ z.T @ rest) and np.allclose(u["mat"], 0.1 * a @ m.T @ rest)


def test_summary_statistics_and_phenotypes(spark):
    s = T.summary_statistics(lines(spark, "SNP EFFECT_ALLELE A2 BETA\nr1 a c 0.1\nr1 a c 0.2\nr2 a c x")).collect()
    assert [tuple(r) for r in s] == [("r1", "A", "C", 0.2)]
    p = T.phenotypes(lines(spark, "ID,t,f\na,1,x\nb,na,x\nc,2,.\nd,3"), "t", ["f"]).orderBy("line").collect()
    assert [r["why"] for r in p] == [None, "trait", "missing f", "short row"]


def test_variances_of_a_long_file(spark):
    text = "Item Var\n u 0.4\n" + "pe 0.1\n\n" * 800 + "note x\nE 0.5\nresidual\t0.6"
    assert T.variances(lines(spark, text)) == (0.4, 0.6)
    assert T.variances(lines(spark, "e 0.3")) == (0.0, 0.3)
    with pytest.raises(ValueError):
        T.variances(lines(spark, "item var\nu"))


def test_stream_equals_batch(spark, geno, tmp_path):
    from kinforge.streaming.additive import streaming_counts

    geno.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming_counts(spark.readStream.schema(geno.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    key = lambda d: sorted(map(tuple, d.collect()))
    assert key(spark.table("counts")) == key(G.snp_counts(geno))


def test_entry_has_sql_for_known_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_reml_modes_agree():
    rng = np.random.default_rng(5)
    b = rng.normal(size=(150, 60))
    g, x, n = b @ b.T / 60, np.ones((150, 1)), 150
    y = rng.multivariate_normal(np.zeros(n), 0.8 * g + 0.5 * np.eye(n))
    best = V.ai_reml(y, x, [g])["s2"]
    eye, k = [np.eye(n)], [g + 1e-6 * np.eye(n)]
    assert np.allclose(V.emai_reml(y, x, eye, k)["s2"], best, rtol=1e-2)
    assert np.allclose(V.hi_reml(y, x, eye, k)["s2"], best, rtol=1e-2)
    fit = V.difference_reml(y, x, [g])
    assert fit["converged"] and np.allclose(fit["s2"], best, rtol=1e-2)
    assert np.allclose(V.em_reml(y, x, eye, k, rounds=2000, tol=1e-8)["s2"], best, rtol=2e-2)
    assert np.allclose(V.mc_em(y, x, k[0], samples=200, rounds=80)["s2"], best, rtol=0.25)
    with pytest.warns(UserWarning):
        assert not V.em_reml(y, x, eye, k, rounds=2)["converged"]


def test_traces_and_low_rank():
    rng = np.random.default_rng(7)
    b = rng.normal(size=(60, 60))
    a = b @ b.T / 60 + np.eye(60)
    mean, se = V.lanczos_log_trace(lambda v: a @ v, 60, steps=30, samples=200)
    assert abs(mean - np.linalg.slogdet(a)[1]) < 4 * se + 0.05
    trace, se, draws = V.adaptive_trace(lambda v: a @ v, 60)
    assert abs(trace - np.trace(a)) < 5 * se and draws >= 20
    mean, se = V.hutchinson(lambda v: a @ v, 60, 400)
    assert abs(mean - np.trace(a)) < 5 * se
    solve, logs = V.low_rank_solver(a, 60, 0.1)
    assert np.allclose(solve(b), np.linalg.solve(a + 0.1 * np.eye(60), b)) and logs == pytest.approx(np.linalg.slogdet(a + 0.1 * np.eye(60))[1])
    low = V.spd(np.diag([1.0, -1.0]))
    assert np.linalg.eigvalsh(low).min() > 0 and np.allclose(G.jittered_inverse(a) @ a, np.eye(60))
    with pytest.raises(np.linalg.LinAlgError):
        G.jittered_inverse(np.diag([1.0, -1.0]))


def test_equation_wald_and_heritability(spark):
    rng = np.random.default_rng(2)
    rows = [(i, float(v), "pq"[i % 2], "xyz"[i % 3], float(i % 5), i % 4) for i, v in enumerate(rng.normal(size=40))]
    records = spark.createDataFrame(rows, "rec long, t double, a string, a_b string, z double, lev long")
    model = MixedModel.from_equation(records, "t = 1 + a + a_b + id").fixed([], ["z"]).random("h", "lev", 4)
    s = model.solve({"h": 0.3, "e": 0.7})
    assert [(r["factor"], r["df"]) for r in s.anova] == [("a", 1), ("a_b", 2), ("z", 1)]  # a's columns are not those of a_b
    x = np.column_stack([np.ones(40), *[[r[2] == "q" for r in rows]], *[[r[3] == v for r in rows] for v in "yz"], [r[4] for r in rows]]).astype(float)
    z = np.eye(4)[[r[5] for r in rows]]
    vi = np.linalg.inv(0.3 * z @ z.T + 0.7 * np.eye(40))
    c = np.linalg.inv(x.T @ vi @ x)
    beta = c @ x.T @ vi @ np.array([r[1] for r in rows])
    assert np.allclose(s.beta, beta) and np.allclose(s.se, np.sqrt(np.diag(c)))
    f = float(beta[2:4] @ np.linalg.solve(c[2:4, 2:4], beta[2:4])) / 2
    assert s.anova[1]["f"] == pytest.approx(f) and s.anova[1]["p"] == pytest.approx(f_tail(f, 2, 35))
    from kinforge.plans.mixed_model import heritability

    rows = heritability({"u": 1.0, "e": 3.0}, {"u": 0.5, "e": 0.5})
    assert rows[0]["share"] == 0.25 and rows[0]["share_se"] == pytest.approx(((0.1875 * 0.5) ** 2 + (0.0625 * 0.5) ** 2) ** 0.5) and 0 < rows[0]["p"] < 0.1


def test_random_regression_equals_dense(spark):
    from kinforge.plans import random_regression as RR

    rng = np.random.default_rng(9)
    rows = [(i, i % 5, float(1 + (i * 3) % 7), float(v)) for i, v in enumerate(rng.normal(size=60))]
    records = spark.createDataFrame(rows, "rec long, id long, t double, y double")
    fit = RR.fit(records, "t", 5, None, {"u": 0.6, "pe": 0.2, "e": 0.5}, 1, level="id", permanent=True)
    phi = RR.legendre_values(np.array([r[2] for r in rows]), 1.0, 7.0, 1)
    z = [np.eye(5)[[r[1] for r in rows]] * phi[:, [k]] for k in (0, 1)]
    y, one = np.array([r[3] for r in rows]), np.ones((60, 1))

    def blup(ku):
        g = {(a, b): np.kron(np.eye(1), np.eye(5)) * ku[a, b] for a in (0, 1) for b in (0, 1)}
        v = sum(z[a] @ g[a, b] @ z[b].T for a in (0, 1) for b in (0, 1)) + sum(0.2 * m @ m.T for m in z) + 0.5 * np.eye(60)
        vi = np.linalg.inv(v)
        r = vi @ (y - one @ np.linalg.solve(one.T @ vi @ one, one.T @ vi @ y))
        return np.stack([sum(ku[a, b] * z[b].T @ r for b in (0, 1)) for a in (0, 1)], 1)

    first = blup(0.6 * np.eye(2))
    k = RR.covariance_of(first)
    assert np.allclose(fit.k["u"], k)
    want = blup(k)
    got = np.array([[r["c0"], r["c1"]] for r in fit.coefficients().orderBy("idx").collect()])
    assert np.allclose(got, want)
    curve = {(r["idx"], r["t"]): r["value"] for r in fit.curves().collect()}
    assert len(curve) == 35 and curve[2, 4.0] == pytest.approx(float(want[2] @ RR.legendre_values(np.array([4.0]), 1.0, 7.0, 1)[0]))


def test_products_without_the_matrix(spark, geno):
    from kinforge.plans import genomic as GP

    packed = G.pack(geno, 6)
    g = coo.dense(G.full(G.relationship(geno, 6)), 6)
    product = GP.GenomicProduct(packed, 6)
    v = np.random.default_rng(1).normal(size=(6, 3))
    assert np.allclose(product(v), g @ v) and np.allclose(product.diagonal(), np.diag(g))
    y, x = np.array([1.0, 2, 0, 1, 3, 2]), np.ones((6, 1))
    out = GP.gblup(product, y, x, (0.4, 0.6))
    vi = np.linalg.inv(0.4 * g + 0.6 * np.eye(6))
    beta = (x.T @ vi @ y) / (x.T @ vi @ x)[0, 0]
    assert out["converged"] and np.allclose(out["u"], 0.4 * g @ vi @ (y - beta[0]), atol=1e-7)
    r = y - y.mean()
    he = GP.haseman_elston(product, y, x, samples=400)["s2"]
    exact = np.linalg.solve([[(g * g).sum(), np.trace(g)], [np.trace(g), 6]], [r @ g @ r, r @ r])
    assert np.allclose(he, np.maximum(exact, 1e-6), atol=0.35)
    pcs, want = G.principal_components_of(packed, 6, 2, maf=0.01, rounds=200), G.principal_components(g, 2)
    assert np.allclose(np.abs(pcs.T @ want), np.eye(2), atol=1e-3)
    apy = coo.dense(G.apy_blocks(G.full(G.relationship(geno, 6)).unionByName(coo.identity(spark, 6)).groupBy("i", "j").agg(F.sum("v").alias("v")), spark.range(3).toDF("i")), 6)
    assert np.allclose(apy, G.apy_inverse(g + np.eye(6), np.arange(3)))
    effects = spark.createDataFrame([(s, 0.5 * s) for s in range(4)], "snp long, beta double")
    zv = np.array([r["v"] for r in G.times_variants(packed, effects).orderBy("sample").collect()])
    centred = np.nan_to_num(DOSAGE - np.nanmean(DOSAGE, 1, keepdims=True))
    assert np.allclose(zv, np.array([0, 0.5, 1, 1.5]) @ centred)


def test_streamed_scores_equal_batch(spark, geno, tmp_path):
    from kinforge.streaming.additive import streaming_scores

    geno.repartition(2).write.parquet(str(tmp_path / "in"))
    effects = spark.createDataFrame([(s, 0.1 * s) for s in range(4)], "snp long, beta double")
    stream = streaming_scores(spark.readStream.schema(geno.schema).parquet(str(tmp_path / "in")), effects)
    run = stream.writeStream.format("memory").queryName("scores").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r["sample"]: r["score"] for r in spark.table("scores").collect()}
    want = {r["sample"]: r["score"] for r in G.scores(geno, spark.range(6).toDF("sample"), effects).collect()}
    assert got.keys() == want.keys() and np.allclose([got[i] for i in want], list(want.values()))


def test_pedigree_sweeps_equal_paths(spark):
    rng = np.random.default_rng(4)
    rows = [(i, None if i < 6 else int(rng.integers(0, i)), None if i < 4 else int(rng.integers(0, i))) for i in range(60)]
    ped = spark.createDataFrame(rows, "idx long, sire long, dam long")
    a = np.zeros((60, 60))  # by the tabular method
    for i, s, d in rows:
        for j in range(i):
            a[i, j] = a[j, i] = 0.5 * ((a[j, s] if s is not None else 0) + (a[j, d] if d is not None else 0))
        a[i, i] = 1 + (0.5 * a[s, d] if s is not None and d is not None else 0)
    f = P.inbreeding(ped)
    assert np.allclose([r["f"] for r in f.orderBy("idx").collect()], np.diag(a) - 1)
    assert np.allclose(coo.dense(P.relationship(ped, f, cells=500), 60), a)
    assert np.allclose(coo.dense(P.a_inverse(ped, f), 60) @ a, np.eye(60))
    P.FAMILIES, old = 3, P.FAMILIES
    try:
        assert np.allclose([r["f"] for r in P.inbreeding(ped).orderBy("idx").collect()], np.diag(a) - 1)
    finally:
        P.FAMILIES = old


def test_sources_by_name(tmp_path):
    assert [T.label_of(p) for p in ("/x/run.GAinv.txt", "a/PA.bin", "HAinv.sparse", "inv")] == ["GA", "PA", "HA", "inv"]
    (tmp_path / "m.GAinv.txt").write_text("1 1 2\n2 2 2\n")
    (tmp_path / "m.GA.id").write_text("a\nb\n")
    want = (str(tmp_path / "m.GAinv.txt"), str(tmp_path / "m.GA.id"))
    assert T.inverse_files(str(tmp_path / "m.GAinv.txt")) == want == T.inverse_files(str(tmp_path))
    (tmp_path / "m.GA.id").unlink()
    with pytest.raises(FileNotFoundError):
        T.inverse_files(str(tmp_path))
