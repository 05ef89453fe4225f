"""Text tables: lines, delimiters, header resolution, missing tokens, and the scans built on them.

A text source is a DataFrame of (line BIGINT, text STRING). Every scan is a DataFrame program over that, so a file
of any size is split by Spark; only the header line reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.operators.pedigree import numbered

# Missing phenotype tokens (any case) and unknown parents (this case only).
MISSING = ("", "na", "nan", ".", "null")
UNKNOWN_PARENT = ("", "NA", "0", ".")
PEDIGREE_HEADERS = ("id", "animal", "ind")
# Header synonyms of summary statistics (upper case).
SUMMARY_NAMES = {
    "snp": ("SNP", "VARIANT_ID", "ID"),
    "a1": ("A1", "EFFECT_ALLELE", "ALLELE1"),
    "a2": ("A2", "OTHER_ALLELE", "ALLELE2"),
    "beta": ("BETA", "BETA_1", "SCORE", "EFFECT", "SBLUP_EFFECT"),
}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, text) of a text file; line numbers rise in file order but need not be dense."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*MISSING)


def number(c: Column) -> Column:
    """The token as a double; null if missing or not a number."""
    return F.when(~is_missing(c), F.trim(c).try_cast("double"))


def fields(text: Column, comma: bool) -> Column:
    """Fields of a line: trimmed comma parts, or parts between white space."""
    return F.transform(F.split(text, ","), lambda x: F.trim(x)) if comma else F.split(F.trim(text), r"\s+")


def first_line(source: DataFrame) -> tuple[int, str] | None:
    """Number and text of the first line that isn't blank."""
    first = source.where(F.trim("text") != "").orderBy("line").limit(1).collect()
    return (first[0]["line"], first[0]["text"]) if first else None


def names_of(text: str) -> tuple[list[str], bool]:
    """Names in a header, and whether commas delimit; a line that begins with white space lacks the id's name."""
    comma = "," in text
    names = [x.strip() for x in text.split(",")] if comma else text.split()
    if not comma and text[:1] in (" ", "\t"):
        names = ["ID", *names]
    return names, comma


def header_of(source: DataFrame) -> tuple[list[str], bool]:
    first = first_line(source)
    return names_of(first[1]) if first else ([], False)


def body_of(source: DataFrame) -> tuple[list[str], DataFrame]:
    """The header's names, and the lines after it with their fields ``f``; one look at the first line, then a filter."""
    first = first_line(source)
    if first is None:
        return [], source.limit(0).withColumn("f", F.split("text", ","))
    names, comma = names_of(first[1])
    body = source.where((F.col("line") > first[0]) & (F.trim("text") != ""))
    return names, body.withColumn("f", fields(F.col("text"), comma))


def resolve(names: list[str], wanted: str | int, one_based: bool = False) -> int:
    """Place of a column: exact name, then any case, then a number (0-based unless told otherwise)."""
    wanted = str(wanted)
    if wanted in names:
        return names.index(wanted)
    lowered = [n.lower() for n in names]
    if wanted.lower() in lowered:
        return lowered.index(wanted.lower())
    if wanted.isdigit() and 0 <= int(wanted) - one_based < len(names):
        return int(wanted) - one_based
    raise KeyError(f"no column {wanted!r} among {names}")


def id_column(names: list[str], given: str | None = None) -> int:
    for want in [given] if given else ["id", "IID"]:
        try:
            return resolve(names, want)
        except KeyError:
            continue
    raise KeyError("no id column")


def pedigree(source: DataFrame, sire_first: bool | None = None) -> DataFrame:
    """(idx, id, sire, dam): ids numbered by first appearance over all three columns; null for unknown parents.

    The header, if there is one, tells which parent comes first; without one the dam does. Parents without a
    row are founders; of repeated rows the last counts.
    """
    if sire_first is None:
        names = [n.lower() for n in header_of(source)[0]]
        sire_first = "sire" in names and "dam" in names and names.index("sire") < names.index("dam")
    parts = source.where(F.trim("text") != "").withColumn("f", F.split(F.trim("text"), r"\s+"))
    parts = parts.where(~F.lower(F.col("f")[0]).isin(*PEDIGREE_HEADERS))
    known = lambda i: F.when(~F.coalesce(F.get("f", F.lit(i)), F.lit("")).isin(*UNKNOWN_PARENT), F.get("f", F.lit(i)))
    rows = parts.select("line", F.col("f")[0].alias("id"), known(1).alias("p1"), known(2).alias("p2"))
    seen = rows.select("line", F.posexplode(F.array("id", "p1", "p2")).alias("place", "id")).where("id is not null")
    firsts = seen.groupBy("id").agg(F.min(F.struct("line", "place")).alias("at"))
    numbers = numbered(firsts.select("id", "at.line", "at.place"), "line", "place", name="idx").select("id", "idx")
    own = rows.groupBy("id").agg(F.max_by(F.struct("p1", "p2"), "line").alias("p"))
    dam, sire = ("p2", "p1") if sire_first else ("p1", "p2")
    out = numbers.join(own.select("id", F.col("p")[sire].alias("sire_id"), F.col("p")[dam].alias("dam_id")), "id", "left")
    ids = numbers.select(F.col("id").alias("parent"), F.col("idx").alias("parent_idx"))
    for side in ("sire", "dam"):
        out = out.join(ids.toDF(f"{side}_id", side), f"{side}_id", "left")
    return out.select("idx", "id", "sire", "dam")


def phenotypes(
    source: DataFrame,
    trait: str | int,
    factors: list[str] = (),
    covariates: list[str] = (),
    randoms: list[str] = (),
    id_name: str | None = None,
) -> DataFrame:
    """(line, id, y, factors..., covariates..., randoms..., why): ``why`` is null for usable rows, else the reason."""
    names, body = body_of(source)
    at = {c: resolve(names, c) for c in [*factors, *covariates, *randoms]}
    y_at, id_at = resolve(names, trait), id_column(names, id_name)
    cell = lambda i: F.get("f", F.lit(i))
    out = body.select(
        "line",
        cell(id_at).alias("id"),
        number(cell(y_at)).alias("y"),
        (F.size("f") > max([y_at, id_at, *at.values()])).alias("long"),
        *[F.when(~is_missing(cell(at[c])), F.trim(cell(at[c]))).alias(c) for c in [*factors, *randoms]],
        *[number(cell(at[c])).alias(c) for c in covariates],
    )
    gaps = [F.col(c).isNull() for c in at]
    why = F.when(~F.col("long"), "short row").when(F.col("y").isNull(), "trait")
    for gap, c in zip(gaps, at, strict=True):
        why = why.when(gap, F.lit(f"missing {c}"))
    return out.withColumn("why", why).drop("long")


def last_row_per_id(rows: DataFrame, id_name: str = "id", order: str = "line") -> DataFrame:
    """Of rows with the same id the one with the greatest order."""
    others = [c for c in rows.columns if c != id_name]
    return rows.groupBy(id_name).agg(F.max_by(F.struct(*others), order).alias("r")).select(id_name, "r.*")


def multi_trait(source: DataFrame, traits: list[str] | None = None, id_name: str | None = None, factors: list[str] = (), covariates: list[str] = ()) -> DataFrame:
    """(id, traits..., factors..., covariates...): last row per id; missing traits are null, a row that lacks a factor or
    covariate goes (before the last one is chosen). Without names every other column is a trait."""
    names, body = body_of(source)
    id_at = id_column(names, id_name)
    others = {*factors, *covariates}
    traits = traits or [n for i, n in enumerate(names) if i != id_at and n.upper() not in ("FID", "IID", "ID") and n not in others]
    cell = lambda c: F.get("f", F.lit(resolve(names, c, one_based=True)))
    cols = [number(cell(c)).alias(c) for c in [*traits, *covariates]] + [F.when(~is_missing(cell(c)), F.trim(cell(c))).alias(c) for c in factors]
    rows = body.select("line", F.get("f", F.lit(id_at)).alias("id"), *cols)
    if others:
        rows = rows.dropna(subset=list(others))
    return last_row_per_id(rows).select("id", *traits, *factors, *covariates)


def triplets(source: DataFrame, zero: float = 1e-9) -> DataFrame:
    """Symmetric matrix (i, j, v), 0-based, from a dense or a triplet text; see ``symmetric``."""
    parts = source.where(F.trim("text") != "").withColumn("f", fields(F.col("text"), False))
    n, width = parts.agg(F.count(F.lit(1)), F.max(F.size("f"))).first()
    if not n:
        return parts.select(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0.0).alias("v")).limit(0)
    if width == n and n != 3:
        rows = numbered(parts.select("line", "f"), "line", name="i")
        cells = rows.select("i", F.posexplode("f").alias("j", "v")).select("i", F.col("j").cast("long"), F.col("v").cast("double"))
        return cells.where(F.abs("v") > zero)
    cells = parts.select(*[F.col("f")[k].cast(t).alias(c) for k, (c, t) in enumerate((("i", "long"), ("j", "long"), ("v", "double")))])
    base = cells.agg(F.min(F.least("i", "j"))).first()[0]
    one = 0 if base == 0 else 1
    return symmetric(cells.select((F.col("i") - one).alias("i"), (F.col("j") - one).alias("j"), "v"), zero)


def symmetric(cells: DataFrame, zero: float = 1e-9) -> DataFrame:
    """Mirrors a triangle; a matrix with entries on both sides of the diagonal stays; |v| <= zero goes."""
    cells = cells.where(F.abs("v") > zero)
    low, high = cells.agg(F.count_if(F.col("i") > F.col("j")), F.count_if(F.col("i") < F.col("j"))).first()
    if low and high:
        return cells
    return cells.union(cells.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))


def id_list(source: DataFrame) -> DataFrame:
    """(idx, id) of the non-blank lines, idx from 0."""
    rows = numbered(source.where(F.trim("text") != ""), "line", name="idx")
    return rows.select("idx", F.trim("text").alias("id"))


def variances(source: DataFrame) -> tuple[float, float]:
    """(genetic, residual) variances of a key-value file."""
    f = F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+")
    rows = source.select("line", F.lower(f[0]).alias("key"), F.get(f, F.lit(1)).try_cast("double").alias("v"))
    rows = rows.where("v is not null and key not in ('item', 'var', 'component')")
    rest = F.col("key").isin("e", "error", "residual")
    # the first other row and the last residual one
    u, e = (v or 0.0 for v in rows.agg(F.min_by("v", F.when(~rest, F.col("line"))), F.max_by("v", F.when(rest, F.col("line")))).first())
    if u == 0 and e == 0:
        raise ValueError("no variances")
    return u, e


def summary_statistics(source: DataFrame) -> DataFrame:
    """(snp, a1, a2, beta): by header synonyms, else by place; bad effects go, of repeated SNPs the last counts."""
    first = first_line(source)
    names, comma = names_of(first[1]) if first else ([], False)
    upper = [n.upper() for n in names]
    at = {k: next((upper.index(n) for n in options if n in upper), None) for k, options in SUMMARY_NAMES.items()}
    if any(v is None for v in at.values()):
        at = {k: i for i, k in enumerate(SUMMARY_NAMES)}
    cell = lambda k: F.get("f", F.lit(at[k]))
    rows = source.withColumn("f", fields(F.col("text"), comma)).select(
        "line", cell("snp").alias("snp"), F.upper(cell("a1")).alias("a1"), F.upper(cell("a2")).alias("a2"), cell("beta").try_cast("double").alias("beta")
    )
    return last_row_per_id(rows.where("beta is not null and snp is not null"), "snp").drop("line")


def snp_weights(source: DataFrame) -> DataFrame:
    """(id, weight) of lines ``variant weight``; of repeated variants the last counts, lines without a number go."""
    f = F.split(F.trim("text"), r"\s+")
    rows = source.select("line", F.get(f, F.lit(0)).alias("id"), F.get(f, F.lit(1)).try_cast("double").alias("weight"))
    return last_row_per_id(rows.where("weight is not null and id <> ''")).drop("line")


def populations(source: DataFrame) -> DataFrame:
    """(line, id, pop) of lines ``IID pop`` or ``FID IID pop``; the latter's id is FID:IID."""
    f = F.split(F.trim("text"), r"\s+")
    two = source.where(F.trim("text") != "").select("line", f.alias("f"))
    long = F.size("f") >= 3
    return two.where(F.size("f") >= 2).select(
        "line", F.when(long, F.concat_ws(":", F.col("f")[0], F.col("f")[1])).otherwise(F.col("f")[0]).alias("id"), F.when(long, F.get("f", F.lit(2))).otherwise(F.col("f")[1]).alias("pop")
    )


def core_flags(samples: DataFrame, source: DataFrame) -> DataFrame:
    """(sample, id, core): which of (sample, id) an id file names; an error if it names none."""
    named = source.where(F.trim("text") != "").select(F.trim("text").alias("id")).distinct().withColumn("core", F.lit(True))
    out = samples.select("sample", "id").join(named, "id", "left").select("sample", "id", F.coalesce("core", F.lit(False)).alias("core"))
    if out.where("core").isEmpty():
        raise ValueError("the core file names no genotyped animal")
    return out


def label_of(path: str) -> str:
    """Name of a component from the file of its inverse: without folder, endings of formats and a trailing ``inv``."""
    name = path.rstrip("/").rpartition("/")[2]
    for ending in (".bin", ".txt", ".sparse", ".gz"):
        name = name.removesuffix(ending)
    name = name.rpartition(".")[2] or name
    return name[:-3] if len(name) > 3 and name.lower().endswith("inv") else name


def inverse_files(path: str) -> tuple[str, str]:
    """(matrix, ids): for a file, its neighbour whose name has ``id``; in a folder, the pair of an ``inv`` and an ``id``
    file (with as many ids as the matrix has rows, if there are several)."""
    from pathlib import Path

    at = Path(path)
    if at.is_file():
        ids = sorted(p for p in at.parent.iterdir() if p.is_file() and p != at and "id" in p.name.lower())
        own = [p for p in ids if p.name.startswith(at.name.partition(".")[0])] or ids
        if not own:
            raise FileNotFoundError(f"{path}: no file of ids beside it")
        return str(at), str(own[0])
    files = sorted(p for p in at.iterdir() if p.is_file())
    inverses, ids = ([p for p in files if word in p.name.lower()] for word in ("inv", "id"))
    lines_in = lambda p: sum(1 for line in p.open(errors="replace") if line.strip())
    pairs = [(m, i) for m in inverses for i in ids if m != i]
    if len(pairs) > 1:
        order = lambda m: max((int(line.split()[0]) for line in m.open() if line.strip()), default=0)
        pairs = [(m, i) for m, i in pairs if m.suffix != ".bin" and lines_in(i) in (lines_in(m), order(m))] or pairs
    if not pairs:
        raise FileNotFoundError(f"{path}: no pair of an inverse and its ids")
    return str(pairs[0][0]), str(pairs[0][1])
