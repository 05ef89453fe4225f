"""File-to-answer runs by the command line, and binary sources."""

import csv
import struct
import zlib

import numpy as np
import pytest

from kinforge import cli
from kinforge.operators import coo
from kinforge.sources import genotypes as GS
from kinforge.sources import matrices as M
from kinforge.sources import text as T

NAN = np.nan
DOSAGE = np.array([[0, 1, 2, 1], [1, 1, 0, 2], [2, 0, 1, 1], [1, 2, 1, 0], [2, 1, 1, NAN], [0, 2, 2, 1]]).T


@pytest.fixture()
def toy(tmp_path):
    rows = ["FID IID batch age Trait Trait2", "0 sample1 A 10 10.0 20.1", "0 sample2 A 11 11.2 21.0", "0 sample3 B 12 13.1 25.9", "0 sample4 B 13 14.0 28.2", "0 sample5 A 14 16.3 32.1", "0 sample6 B 15 17.1 34.0"]
    (tmp_path / "toy.pheno").write_text("\n".join(rows) + "\n")
    (tmp_path / "toy.ped").write_text("id sire dam\nsample1 0 0\nsample2 0 0\nsample3 sample1 sample2\nsample4 sample1 sample2\nsample5 sample3 sample4\nsample6 sample3 sample4\n")
    (tmp_path / "g.bed").write_bytes(GS.encode_bed(DOSAGE))
    (tmp_path / "g.bim").write_text("".join(f"1 snp{k + 1} 0 {k + 1} A C\n" for k in range(4)))
    (tmp_path / "g.fam").write_text("".join(f"0 sample{k + 1} 0 0 0 -9\n" for k in range(6)))
    return tmp_path


def table(path):
    with open(path, encoding="utf-8") as file:
        return list(csv.DictReader(file, delimiter="\t"))


def run(spark, *args, code=0):
    assert cli.main([str(a) for a in args], spark) == code


def test_options(capsys):
    assert cli.main([]) == 1 and cli.main(["--help"]) == 0 and "PBLUP" in capsys.readouterr().out
    assert cli.main(["--version"]) == 0 and cli.main(["--help=relationship"]) == 0 and "Relationship task help" in capsys.readouterr().out
    for args, words in (
        (["--not-an-option"], "Unknown option"), (["--threads"], "missing value"), (["--threads", "0", "--out", "x"], "positive"), (["--blup"], "--out"),
        (["--vce-mode", "zz", "--out", "x"], "Invalid"), (["--matrix", "m", "--out", "x"], "--matrix-id"), (["--var-a", "1", "--out", "x"], "both be positive"),
        (["--make-matrix", "--relationship", "g", "--out", "x"], "genotypes"), (["--output-format", "xls", "--out", "x"], "Unsupported"), (["--npc", "two", "--out", "x"], "not a number"),
    ):
        assert cli.main(args) == 2 and words in capsys.readouterr().err
    o, threads = cli.parse(["--model", "y = 1 + herd + id + sex", "--thread", "3", "--vce-method", "hybrid", "--dcovar", "3,4", "--fast", "--out", "x"])
    assert (o.pheno_name, o.factors, threads, o.vce_mode, o.se, o.matrix_free) == ("y", ["2", "3", "herd", "sex"], 3, "emai", False, True)


def test_pedigree_blup(spark, toy):
    run(spark, "--blup", "--model", "pblup", "--ped", toy / "toy.ped", "--pheno", toy / "toy.pheno", "--pheno-name", "Trait", "--skip-vce", "--var-a", 0.3, "--var-e", 0.7, "--out", toy / "deep/p")
    assert float(table(toy / "deep/p.beta")[0]["Estimation"]) == pytest.approx(13.080654, abs=1e-4)
    rand = table(toy / "deep/p.rand")
    assert [r["ID"] for r in rand] == [f"sample{k}" for k in range(1, 7)] and all(r["n_obs"] == "1" for r in rand)
    assert np.allclose([float(r["PA"]) for r in rand], [-0.18, 0.18, 0.452157, 0.610980, 1.005882, 1.147059], atol=1e-5)
    obs = table(toy / "deep/p.obsrand")
    assert all(float(r["Y"]) == pytest.approx(float(r["Fitted"]) + float(r["Residual"]), abs=1e-4) for r in obs)
    assert (toy / "deep/p.log").stat().st_size


def test_genomic_models_and_exports(spark, toy):
    run(spark, "--make-matrix", "--make-inv", "--relationship", "g", "--bfile", toy / "g", "--rc", "--pca", "--npc", 2, "--allele-freq", "--homo", "--hete", "--dom", "--epi", "--out", toy / "x")
    first = (toy / "x.GA.txt").read_text().splitlines()[0].split()
    assert first[:2] == ["1", "1"] and float(first[2]) == pytest.approx(0.873239, abs=1e-5)
    assert (toy / "x.GA.id").read_text().split() == [f"sample{k}" for k in range(1, 7)]
    assert len(table(toy / "x.rc")) == 21 and len(table(toy / "x.pca")) == 6 and {"PC1", "PC2"} <= set(table(toy / "x.pca")[0])
    assert [float(r["FREQ_A1"]) for r in table(toy / "x.frq")] == pytest.approx([0.5, 0.583333, 0.583333, 0.5], abs=1e-5)
    assert {r["ID"]: r["count"] for r in table(toy / "x.homo")}["sample1"] == "2"
    g = coo.dense(T.triplets(spark.createDataFrame(list(enumerate((toy / "x.GA.txt").read_text().splitlines())), "line long, text string")), 6)
    run(spark, "--make-matrix", "--relationship", "g", "--bfile", toy / "g", "--output-format", "bin", "--magic", "SOME_UPPER_PACKED", "--out", toy / "b")
    raw = (toy / "b.GA.bin").read_bytes()
    assert raw[:17] == b"SOME_UPPER_PACKED" and np.allclose(M.read_packed(raw), g, atol=1e-5)
    assert np.allclose(coo.dense(M.binary_rows(spark, str(toy / "b.GA.bin"), 6, piece=100), 6), g, atol=1e-5)
    common = ["--pheno", toy / "toy.pheno", "--pheno-name", "Trait", "--skip-vce", "--var-a", 0.3, "--var-e", 0.7, "--no-se"]
    run(spark, "--blup", "--model", "gblup", "--bfile", toy / "g", *common, "--ridge", 0.01, "--snp-effect", "--out", toy / "g1")
    run(spark, "--blup", "--model", "gblup", "--matrix", toy / "x.GA.txt", "--matrix-id", toy / "x.GA.id", *common, "--ridge", 0.01, "--out", toy / "g2")
    one, two = ([float(r[c]) for r in table(toy / f"{n}.rand")] for n, c in (("g1", "GA"), ("g2", "GA")))
    assert np.allclose(one, two, atol=1e-3) and len(table(toy / "g1.snp_eff")) == 4
    run(spark, "--blup", "--model", "ssgblup", "--ped", toy / "toy.ped", "--bfile", toy / "g", *common, "--out", toy / "s")
    assert len(table(toy / "s.rand")) == 6
    run(spark, "--make-matrix", "--make-inv", "--ped", toy / "toy.ped", "--bfile", toy / "g", "--ibc", "--out", toy / "h")
    h, hi = (coo.dense(T.triplets(spark.createDataFrame(list(enumerate((toy / f"h.{n}.txt").read_text().splitlines())), "line long, text string")), 6) for n in ("HA", "HAinv"))
    assert np.allclose(h @ hi, np.eye(6), atol=1e-3) and [float(r["F"]) for r in table(toy / "h.ibc")] == [0, 0, 0, 0, 0.25, 0.25]


def test_multi_trait_regression_and_tasks(spark, toy):
    run(spark, "--multi-trait", "--model", "gblup", "--bfile", toy / "g", "--pheno", toy / "toy.pheno", "--pheno-name", "Trait,Trait2", "--dcovar", "batch", "--vce", "--vce-max-iter", 5, "--ridge", 0.01, "--out", toy / "m")
    assert len(table(toy / "m.mv.vars")) == 4 and len(table(toy / "m.rand")) == 6 and {"Trait", "Trait2"} <= set(table(toy / "m.rand")[0])
    records = "".join(f"sample{1 + k % 6} {11 + k % 4} {20 + (k * 7) % 5 + k % 4}\n" for k in range(24))
    (toy / "rr.phe").write_text("id age milk\n" + records)
    run(spark, "--rrm", "--ped", toy / "toy.ped", "--pheno", toy / "rr.phe", "--pheno-name", "milk", "--qcovar", "age", "--time-col", "age", "--rrm-order", 1, "--pe", "--vars", toy / "v", "--out", toy / "r", code=2)
    (toy / "v").write_text("u 1\ne 2\n")
    run(spark, "--rrm", "--ped", toy / "toy.ped", "--pheno", toy / "rr.phe", "--pheno-name", "milk", "--time-col", "age", "--rrm-order", 1, "--pe", "--vars", toy / "v", "--out", toy / "r")
    assert len(table(toy / "r.rrcurve")) == 2 * 6 * 4 and len(table(toy / "r.rrk")) == 8 and len(table(toy / "r.rrcoef")) == 12 and (toy / "r.rrm.meta.txt").stat().st_size
    run(spark, "--blup", "--ped", toy / "toy.ped", "--pheno", toy / "rr.phe", "--pheno-name", "milk", "--qcovar", "age", "--pe", "--vce", "--out", toy / "q")
    items = [r["Item"] for r in table(toy / "q.vars")]
    assert items == ["PA", "Pe", "e", "Repeatability"] and [r["Factors"] for r in table(toy / "q.anova")] == ["age", "e"]
    run(spark, "--qc", "--bfile", toy / "g", "--geno", 0.1, "--out", toy / "qc")
    assert (toy / "qc.keep.snp").read_text().split() == ["snp1", "snp2", "snp3"] and len(table(toy / "qc.qc.id")) == 6
    (toy / "sum.txt").write_text("SNP A1 A2 BETA\nsnp1 A C 0.10\nsnp2 A C -0.05\nsnp3 A C 0.08\nsnp4 A C 0.02\n")
    run(spark, "--sblup", "--bfile", toy / "g", "--sumstat", toy / "sum.txt", "--h2", 0.3, "--window-num", 4, "--out", toy / "sb")
    assert np.allclose([float(r["SBLUP_EFFECT"]) for r in table(toy / "sb.sblup.eff")], [0.047060, -0.011688, 0.045798, 0.013433], atol=1e-5)
    run(spark, "--pred", "--bfile", toy / "g", "--score", toy / "sb.sblup.eff", "--out", toy / "pr")
    assert np.allclose([float(r["SCORE"]) for r in table(toy / "pr.profile")], [0.093340, 0.062238, 0.153350, 0.069482, 0.128230, 0.081652], atol=1e-5)


def bgen_bytes(dosage, compression):
    m, n = dosage.shape
    ids = [f"s{k}".encode() for k in range(n)]
    block = struct.pack("<I", n) + b"".join(struct.pack("<H", len(i)) + i for i in ids)
    block = struct.pack("<I", len(block) + 4) + block
    out = struct.pack("<IIII", 20 + len(block), 20, m, n) + b"bgen" + struct.pack("<I", compression | 2 << 2 | 1 << 31) + block
    for k in range(m):
        out += b"".join(struct.pack("<H", len(x)) + x for x in (b"v", f"rs{k}".encode(), b"7")) + struct.pack("<IH", 100 + k, 2)
        out += b"".join(struct.pack("<I", 1) + x for x in (b"A", b"C"))
        missing = np.isnan(dosage[k])
        two = np.array([(255, 0) if d == 0 else (0, 255) if d == 1 else (0, 0) for d in dosage[k]], np.uint8)  # of no and of one second allele
        raw = struct.pack("<IHBB", n, 2, 2, 2) + np.where(missing, 0x82, 2).astype(np.uint8).tobytes() + bytes([0, 8]) + two.tobytes()
        if compression == 1:
            packed = zlib.compress(raw)
            out += struct.pack("<II", len(packed) + 4, len(raw)) + packed
        elif compression == 2:
            import zstandard

            packed = zstandard.ZstdCompressor().compress(raw)
            out += struct.pack("<II", len(packed) + 4, len(raw)) + packed
        else:
            out += struct.pack("<I", len(raw)) + raw
    return out


@pytest.mark.parametrize("compression", [0, 1, 2])
def test_bgen(spark, tmp_path, compression):
    (tmp_path / "x.bgen").write_bytes(bgen_bytes(DOSAGE, compression))
    variants, dosage = GS.bgen(spark, str(tmp_path / "x.bgen"), step=3)
    got = np.array([[NAN if v is None else v for v in r["dosage"]] for r in dosage.orderBy("snp").collect()])
    assert np.array_equal(got, DOSAGE, equal_nan=True) and [r["id"] for r in variants.orderBy("snp").collect()] == ["rs0", "rs1", "rs2", "rs3"]
    assert [(r["a1"], r["a2"]) for r in variants.collect()] == [("C", "A")] * 4  # dosages count the second allele
    assert GS.bgen_samples(str(tmp_path / "x.bgen")) == [f"s{k}" for k in range(6)]


def test_plink2_tables(spark, tmp_path):
    (tmp_path / "x.psam").write_text("#IID SEX\na 1\nb 2\n")
    (tmp_path / "x.pvar").write_text("##fileformat\n#CHROM POS ID REF ALT\n1 5 rs1 C A\n2 7 rs2 G T\n")
    assert [tuple(r) for r in GS.psam(spark, str(tmp_path / "x.psam")).orderBy("sample").collect()] == [(0, "0", "a"), (1, "0", "b")]
    assert [tuple(r) for r in GS.pvar(spark, str(tmp_path / "x.pvar")).orderBy("snp").collect()] == [(0, "1", "rs1", 5, "A", "C"), (1, "2", "rs2", 7, "T", "G")]


def test_binary_matrices(spark, tmp_path):
    m = np.array([[2.0, 0.5, 0], [0.5, 1.0, 0.25], [0, 0.25, 3]])
    (tmp_path / "p.bin").write_bytes(M.write_packed(m))
    (tmp_path / "t.bin").write_bytes(M.write_triangle(m))
    cells = [(i + 1, j + 1, m[i, j]) for i in range(3) for j in range(i + 1) if m[i, j]]
    (tmp_path / "c.bin").write_bytes(b"".join(struct.pack("<iif", *c) for c in cells))
    for name in "ptc":
        assert np.array_equal(coo.dense(M.binary_rows(spark, str(tmp_path / f"{name}.bin"), 3, piece=24), 3), m), name
    (tmp_path / "bad.bin").write_bytes(M.write_packed(m) + b"x")
    with pytest.raises(ValueError):
        M.binary_rows(spark, str(tmp_path / "bad.bin"), 3)
