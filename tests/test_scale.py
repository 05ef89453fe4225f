"""Steps that large tables go through: the same results by other forms, and plans that do not gather or shuffle by size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinforge.operators import genotypes as G
from kinforge.sources import genotypes as GS


@pytest.fixture(scope="module")
def forms(spark):
    """The same genotypes as arrays and as bits; variant 3 is constant, 4 all missing."""
    code = np.random.default_rng(5).integers(0, 4, (40, 75)).astype(np.uint8)
    code[3], code[4] = 1, 3
    x = [[None if v == 3 else float(v) for v in row] for row in code.tolist()]
    arrays = spark.createDataFrame(list(enumerate(x)), "snp long, dosage array<double>")
    raw = [bytes(b.as_py()) for b in G.bit_rows(code)]
    return arrays, spark.createDataFrame(list(enumerate(raw)), "snp long, dosage binary")


def same(a, b, *key):
    a, b = (d.toPandas().sort_values(list(key)).reset_index(drop=True) for d in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b) > 0
    for c in a.columns:
        assert np.allclose(a[c].to_numpy(float), b[c].to_numpy(float), atol=1e-9, equal_nan=True), c


def test_bits_equal_arrays(spark, forms):
    arrays, bits = forms
    assert G.width(bits) == 75
    same(GS.long(arrays), GS.long(bits), "snp", "sample")
    for of, key in ((G.snp_quality, "snp"), (G.frequencies, "snp"), (G.sample_quality, "sample")):
        same(of(arrays), of(bits), key)
    same(G.sample_quality(G.filtered(arrays)), G.sample_quality(G.filtered(bits)), "sample")
    groups = spark.range(75).select(F.col("id").alias("sample"), (F.col("id") % 7).alias("grp"))
    same(G.group_frequencies(arrays, groups), G.group_frequencies(bits, groups), "snp", "grp")
    effects = spark.createDataFrame([(s, 0.1 * s - 1) for s in range(0, 40, 3)], "snp long, beta double")
    samples = groups.select("sample")
    same(G.scores(arrays, samples, effects), G.scores(bits, samples, effects), "sample")
    same(G.times_variants(arrays, effects), G.times_variants(bits, effects), "sample")
    q = samples.withColumn("v", F.sin("sample"))
    same(G.snp_effects(arrays, q, 75), G.snp_effects(bits, q, 75), "snp")
    same(G.block_correlations(arrays, 9), G.block_correlations(bits.coalesce(1), 9, adjacent=True), "snp1", "snp2")
    same(G.block_shrinkage(arrays, effects, 75, 40, 0.3, 9), G.block_shrinkage(bits.coalesce(1), effects, 75, 40, 0.3, 9, adjacent=True), "snp")
    weights = effects.select("snp", F.abs("beta").alias("weight"))
    same(G.relationship(arrays, 75, weights=weights), G.relationship(bits, 75, weights=weights), "i", "j")


def test_effects_come_to_the_genotypes(spark, forms):
    """Genotypes were sorted, shuffled or broadcast to be joined to a table of effects."""
    _, bits = forms
    effects = spark.createDataFrame([(s, 1.0) for s in range(40)], "snp long, beta double")
    plan = G.times_variants(bits, effects)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    with pytest.raises(ValueError):
        G.block_shrinkage(bits, effects.union(effects), 75, 40, 0.3)


def test_models_by_tasks_equal_dense(spark, monkeypatch):
    """Matrix and vectors of large models were on the driver; chunks of 8 equations here, effects of a level side by side."""
    from kinforge.operators import pedigree as P
    from kinforge.plans import cluster
    from kinforge.plans.mixed_model import MixedModel

    monkeypatch.setattr(cluster, "CHUNK", 8)
    n, rng = 41, np.random.default_rng(2)
    ped = [(i, int(rng.integers(0, i // 2 + 1)), i // 2 + 1 + int(rng.integers(0, i - i // 2 - 1))) if i > 3 else (i, None, None) for i in range(n)]
    ped = spark.createDataFrame(ped, "idx long, sire long, dam long")
    rows = [(r, int(rng.integers(0, n - 1)), int(rng.integers(0, n)) if r % 3 else None, "abc"[r % 3], "x" if r % 3 == 0 else "y", float(rng.normal()), float(rng.normal())) for r in range(90)]
    # the second factor depends on the first: the fixed effects' part has no full rank
    rows = spark.createDataFrame(rows, "rec long, id long, dam_id long, f string, g string, t double, y double")
    ainv = P.a_inverse(ped, P.inbreeding(ped))
    for factors, pe in ((["f"], n), (["f", "g"], n + 7)):
        model = MixedModel(rows).fixed(factors, ["t"]).random("u", "id", n, ainv).random("pe", "dam_id", pe)
        s2 = {"u": 0.4, "pe": 0.2, "e": 0.6}
        want, got = model.solve(s2), model.solve(s2, dense_cap=0, driver_entries=0)
        assert isinstance(got.u, cluster.Effects) and got.converged
        table = {r["idx"]: r["u"] for r in got.table(spark, {"u": "u"}).collect()}
        assert np.allclose([table[i] for i in range(n)], want.u["u"], atol=1e-7)
        assert np.allclose(got.u["u"], want.u["u"], atol=1e-7) and np.allclose(got.u["pe"], want.u["pe"], atol=1e-7)
        same(model.fitted(want), model.fitted(got), "rec")
        if len(factors) == 1:
            assert np.allclose(got.beta, want.beta) and np.allclose(got.se, want.se)
            assert np.allclose(got.mean_products(spark, ["u", "pe"]), want.mean_products(spark, ["u", "pe"]))
    with pytest.warns(UserWarning):
        assert not model.solve(s2, dense_cap=0, driver_entries=0, rounds=1).converged


def test_relationships_shuffle_no_genotypes(spark, forms):
    """Variants went to a task for each pair of tiles; now tiles are added up where the variants lie, in several passes."""
    from kinforge.plans import genomic as GP

    arrays, bits = forms
    plan = G.sample_products(bits, "dosage", lambda _, x: x.known(), 75, tile=32, whole=0)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan
    z = np.array([[v or 0.0 for v in r["dosage"]] for r in arrays.orderBy("snp").collect()])
    for whole in (0, 64, 128):
        got = G.sample_products(bits, "dosage", lambda _, x: x.known(), 75, tile=32, whole=whole).toPandas()
        want = z.T @ z
        assert len(got) == 75 * 76 // 2 and np.allclose(got["v"], want[got["i"], got["j"]])
    v = np.random.default_rng(3).normal(size=(75, 2))
    for method in (G.VANRADEN, G.ZENG, G.YANG, G.DOMINANCE, G.TRUE_VARIANCE):
        same(G.relationship(arrays, 75, method), G.relationship(bits, 75, method), "i", "j")
    assert np.allclose(GP.GenomicProduct(bits, 75)(v), GP.GenomicProduct(arrays, 75)(v))


def test_gblup_beyond_the_dense_bound(spark, tmp_path, monkeypatch):
    from kinforge import registry

    spark.createDataFrame([(i, i * 37 % 101 * 90.0) for i in range(30)], "s_suppkey long, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame([(i,) for i in range(300)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    want = registry.gblup_fixed(spark, str(tmp_path))
    monkeypatch.setattr(registry, "DENSE_SAMPLES", 10)
    monkeypatch.setattr(registry, "_genomic", None)  # the dense matrix isn't asked for
    same(want, registry.gblup_fixed(spark, str(tmp_path)), "idx")


def test_sparse_columns_equal_sweeps_over_all(spark):
    from kinforge.operators.pedigree import Arrays

    rng, n = np.random.default_rng(4), 60
    sire = np.array([-1 if i < 6 else rng.integers(0, i) for i in range(n)])
    dam = np.array([-1 if i < 6 or i % 9 == 0 else rng.integers(0, i) for i in range(n)])
    dam[10] = sire[10]
    level = np.zeros(n, np.int32)
    for i in range(n):
        level[i] = max([level[p] + 1 for p in (sire[i], dam[i]) if p >= 0], default=0)
    a = Arrays(sire, dam, level, rng.uniform(0.4, 1, n))
    own = np.array([3, 59, 10, 27])
    i, j, v = a.sparse_columns(own, a.children())
    got = np.zeros((n, 4))
    got[i, j] = v
    assert len(set(zip(i, j, strict=True))) == len(i) and np.allclose(got, a.columns(own))


def test_ancestor_steps_are_not_broadcast(spark, monkeypatch):
    from kinforge.operators import pedigree as P

    plans, write = [], P.written
    monkeypatch.setattr(P, "written", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    ped = spark.createDataFrame([(i, i // 2 if i > 3 else None, i // 3 if i > 3 else None) for i in range(40)], "idx long, sire long, dam long")
    assert P.ancestor_paths(ped).count() and P.generations(ped).count() == 40
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)


def test_inverses_are_made_by_a_task(spark, monkeypatch):
    """The core's block and G came to the driver as rows."""
    from kinforge.operators import coo
    from kinforge.sources.matrices import coo as rows_of

    x = np.random.default_rng(6).normal(size=(12, 30))
    g = x @ x.T
    rows, core = rows_of(spark, g), spark.createDataFrame([(i,) for i in (1, 4, 5, 9, 11)], "i long")
    want = G.apy_inverse(g, np.array([1, 4, 5, 9, 11]), 0.1)
    monkeypatch.setattr(coo, "dense", None)
    got = G.apy_blocks(rows, core, 0.1).toPandas()
    m = np.zeros((12, 12))
    m[got["i"], got["j"]] = got["v"]
    assert len(got) == len(got.drop_duplicates(["i", "j"])) and np.allclose(m, want)
    inverse = coo.by_one_task(rows, 12, G.definite_inverse).toPandas()
    m[:] = 0
    m[inverse["i"], inverse["j"]] = inverse["v"]
    assert np.allclose(m, G.psd_inverse(g))
    low = x[:, :4] @ x[:, :4].T  # no full rank: eigenvalues are raised
    assert np.allclose(G.definite_inverse(low), G.psd_inverse(low))
