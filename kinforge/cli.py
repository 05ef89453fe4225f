"""Command line: ``python -m kinforge.cli --blup --ped p.txt --pheno y.txt --pheno-name t --out result``.

Exit codes: 0 done (or help, version), 1 no arguments, 2 an error, which is told on standard error.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import fields

from kinforge.engine import LOG, Engine, Options

VERSION = "kinforge 0.2"
MODES = ("ai", "em", "mc", "he", "emai", "hi", "exact", "vmatrix", "stcg", "fdiff")

# Names of options. Switches set a field to a value; the others take one value for a field.
SWITCHES = {
    "--blup": ("task", "blup"), "--single-trait": ("task", "blup"), "--multi-trait": ("task", "multi"), "--rrm": ("task", "rrm"),
    "--qc": ("task", "qc"), "--sblup": ("task", "sblup"), "--pred": ("task", "pred"),
    "--make-matrix": ("make_matrix", True), "--make-xrm": ("make_matrix", True), "--make-xrm-bin": ("make_matrix", True), "--make-inv": ("make_inv", True),
    "--add-inv": ("add_inv", True), "--dom-inv": ("dom_inv", True), "--epi-inv": ("epi_inv", True), "--add": ("add", True),
    "--dom": ("dom", True), "--epi": ("epi", True), "--pe": ("pe", True), "--mat": ("mat", True),
    "--vce": ("vce", True), "--skip-vce": ("skip_vce", True), "--no-vce": ("skip_vce", True), "--no-se": ("se", False),
    "--fast": ("fast", True), "--matrix-free": ("matrix_free", True), "--mmap": ("matrix_free", True), "--snp-effect": ("snp_effect", True),
    "--apy": ("apy", True), "--no-tuneG": ("tune", False), "--write-txt": ("output_format", "txt"),
    "--ibc": ("ibc", True), "--rc": ("rc", True), "--pca": ("pca", True), "--allele-freq": ("allele_freq", True), "--homo": ("homo", True), "--hete": ("hete", True),
    "--force-dense-exact": ("ignored", True), "--force-exact": ("ignored", True), "--solver-report": ("ignored", True), "--pcg": ("ignored", True), "--PCG": ("ignored", True),
}
VALUES = {
    "out": "--out", "model": "--model", "relationship": "--relationship", "ped": "--ped --pedigree", "bfile": "--bfile", "pfile": "--pfile", "bgen": "--bgen",
    "pheno": "--pheno --phe", "pheno_name": "--pheno-name", "pheno_pos": "--pheno-pos --mpheno", "id_col": "--id-col", "time_col": "--time-col", "order": "--rrm-order",
    "factors": "--dcovar --dcovar-names --covar-name --factor-names --factors", "covariates": "--qcovar --qcovar-names --qcovar-name --covars", "randoms": "--rand",
    "matrix": "--matrix", "matrix_id": "--matrix-id --id --inv-id", "inv": "--inv --xrminv --xrm", "inv_a": "--inv-A", "inv_g": "--inv-G", "inv_a22": "--inv-A22",
    "id_a": "--id-A", "id_g": "--id-G", "variances": "--vars", "priors": "--vc-priors --var-priors --var-prior", "var_a": "--var-a", "var_e": "--var-e",
    "vce_mode": "--vce-mode --vc-method --vce-method --alg", "vce_rounds": "--vce-max-iter --max-vce-iter --ai-maxit --em-maxit --em-iters", "vce_tol": "--vce-tol",
    "tau": "--tau", "omega": "--omega", "alpha": "--alpha", "ridge": "--ridge --ridge-value --ridge-xrm", "code_method": "--code-method --xrm-algo",
    "apy_core_size": "--apy-core-size", "apy_core_file": "--apy-core-file", "pop_class": "--pop-class", "snp_weight": "--snp-weight",
    "output_format": "--output-format", "magic": "--magic", "npc": "--npc", "maf": "--maf", "max_maf": "--max-maf", "hwe": "--hwe", "geno": "--geno", "mind": "--mind",
    "sumstat": "--sumstat", "score": "--score", "h2": "--h2", "window": "--window-num", "pcg_tol": "--pcg-tol", "pcg_rounds": "--pcg-maxit",
    "threads": "--threads --thread", "ignored": "--step --pcg-report --pcg-precond --covc-priors --cov-priors --vce-samples --trace-mode --solver --dense-solver --pcg-num --PCG-num",
}
TAKES = {flag: name for name, flags in VALUES.items() for flag in flags.split()}
RESERVED = ("pblup", "gblup", "ssgblup", "repeatability", "rrm")
TOPICS = {
    "relationship": "Relationship task: --make-matrix or --make-inv with --relationship a, g or h; --ped, --bfile, --pfile, --bgen; --code-method 1 to 5",
    "models": "Models: --blup with --model pblup, gblup, ssgblup or repeatability; --multi-trait; --rrm --time-col c --rrm-order k",
    "variances": f"Variances: --vars file, or --var-a and --var-e, or --vce with --vce-mode {', '.join(MODES)}",
}


def parse(args: list[str]) -> tuple[Options, int]:
    """(options, threads); ValueError for an unknown option, a missing or unfit value, or options that don't go together."""
    kinds = {f.name: f.type for f in fields(Options)}
    given: dict = {}
    rest = iter(args)
    for a in rest:
        if a in SWITCHES:
            name, value = SWITCHES[a]
            given[name] = value
            continue
        if a not in TAKES:
            raise ValueError(f"Unknown option: {a}")
        value = next(rest, None)
        if value is None:
            raise ValueError(f"{a}: missing value")
        name = TAKES[a]
        kind = kinds.get(name, {"threads": "int", "var_a": "float", "var_e": "float"}.get(name, "str"))
        try:
            if kind.startswith("list"):
                parts = [p for p in value.split(",") if p]
                given[name] = [float(p) for p in parts] if "float" in kind else [str(int(p) - 1) if p.isdigit() and a in ("--dcovar", "--factors", "--qcovar", "--covars", "--rand") else p for p in parts]
            else:
                given[name] = {"int": int, "float": float}.get(kind, str)(value)
        except ValueError:
            raise ValueError(f"{a}: {value!r} is not a number") from None
    threads = given.pop("threads", None)
    if threads is not None and threads < 1:
        raise ValueError("--threads must be a positive integer")
    pair = given.pop("var_a", None), given.pop("var_e", None)
    if pair != (None, None):
        if not all(v is not None and v > 0 for v in pair):
            raise ValueError("--var-a and --var-e must both be positive when either is specified")
        given["priors"] = list(pair)
    if given.pop("fast", False):
        given |= {"se": False, "matrix_free": True}
    for name in ("ignored", "add"):
        given.pop(name, None)
    for name in ("relationship", "output_format", "vce_mode"):
        if name in given:
            given[name] = given[name].lower()
    given["vce_mode"] = {"hybrid": "emai"}.get(given.get("vce_mode", "ai"), given.get("vce_mode", "ai"))
    o = Options(**given)
    equation(o)
    check(o)
    return o, threads or 0


def equation(o: Options) -> None:
    """``--model "y = 1 + f1 + f2"``: the first word is the trait unless one is named, the others but 1 and ids factors."""
    if o.model.lower() in RESERVED or not o.model:
        return
    words = [w for w in o.model.replace("+", " ").replace("=", " ").split() if w]
    if not o.pheno_name and words:
        o.pheno_name = words[0]
    o.factors += [w for w in words[1:] if w not in ("1", "id", "iid") and w not in o.factors]


def check(o: Options) -> None:
    typed = bool(o.bfile or o.pfile or o.bgen)
    if o.relationship not in ("", "a", "g", "h"):
        raise ValueError(f"Unsupported --relationship {o.relationship!r}: a, g or h")
    if o.make_matrix or o.make_inv:
        if o.relationship == "g" and not typed or o.relationship == "h" and not (typed and o.ped):
            raise ValueError(f"--relationship {o.relationship} requires genotypes" + (" and --ped" if o.relationship == "h" else ""))
        if o.relationship == "a" and not o.ped:
            raise ValueError("--relationship a requires --ped")
        if not o.pheno and o.task == "blup":
            o.task = "relationship"
    if o.matrix and not o.matrix_id:
        raise ValueError("--matrix requires --matrix-id")
    if o.output_format not in ("txt", "tsv", "bin"):
        raise ValueError(f"Unsupported --output-format {o.output_format!r}: txt, tsv or bin")
    if o.vce_mode not in MODES:
        raise ValueError(f"Invalid --vce-mode {o.vce_mode!r}: {', '.join(MODES)}")
    if not o.out:
        raise ValueError("Missing --out")


def main(args: list[str] | None = None, spark=None) -> int:
    args = sys.argv[1:] if args is None else list(args)
    if not args or "--help" in args or "-h" in args:
        print("\n".join([__doc__.strip(), *TOPICS.values(), "Tasks: PBLUP, GBLUP, single-step, repeatability, random regression, multi-trait, QC, SBLUP, scores"]))
        return 0 if args else 1
    if topic := next((a.partition("=")[2] for a in args if a.startswith("--help=")), None):
        print(f"{topic.capitalize()} task help\n{TOPICS.get(topic, 'no such topic')}")
        return 0
    if "--version" in args:
        print(VERSION)
        return 0
    try:
        options, threads = parse(args)
        if spark is None:
            from pyspark.sql import SparkSession

            builder = SparkSession.builder.appName("kinforge")
            spark = (builder.master(f"local[{threads}]") if threads else builder).getOrCreate()
        handler = _log_to(options.out)
        try:
            LOG.info("%s %s", VERSION, " ".join(args))
            Engine(spark, options).run()
            LOG.info("done")
        finally:
            LOG.removeHandler(handler)
            handler.close()
    except Exception as e:  # every failure is one line and one exit code
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


def _log_to(out: str) -> logging.Handler:
    """Log lines go to ``out``.log (on the driver's disk) and the root logger."""
    from pathlib import Path

    path = Path(f"{out.removeprefix('file://')}.log")
    path.parent.mkdir(parents=True, exist_ok=True)
    handler = logging.FileHandler(path, "w")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    LOG.setLevel(logging.INFO)
    LOG.addHandler(handler)
    return handler


if __name__ == "__main__":
    sys.exit(main())
