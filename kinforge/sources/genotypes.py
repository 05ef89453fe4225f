"""Genotype files as rows of one variant each: (snp BIGINT, dosage ARRAY<DOUBLE>), null where missing.

Readers cut a file into ranges of variants; each task opens the file, seeks to its range and decodes with numpy,
so no task sees more than ``step`` variants at a time. Files are addressed by any URL that pyarrow opens.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "snp long, dosage array<double>"
BED_MAGIC = b"\x6c\x1b\x01"
# Dosage of the first allele by two-bit code; code 1 is missing.
BED_DOSAGE = np.array([2.0, np.nan, 1.0, 0.0])


def _open(url: str):
    from pyarrow import fs

    if "://" in url:
        system, path = fs.FileSystem.from_uri(url)
    else:
        system, path = fs.LocalFileSystem(), url.removeprefix("file:")
    return system.open_input_file(path)


def _rows(first: int, dosage: np.ndarray) -> pa.RecordBatch:
    """A batch of variants (variant x sample), NaN as null."""
    n, m = dosage.shape
    flat = pa.array(dosage.ravel(), pa.float64(), from_pandas=True)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), flat)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + n), pa.int64()), lists], ["snp", "dosage"])


def fam(spark: SparkSession, path: str) -> DataFrame:
    """(sample, fid, iid, father, mother, sex, phenotype) of a .fam file, sample from 0 in file order."""
    from kinforge.sources.text import id_list, lines

    f = F.split("id", r"\s+")
    names = (("fid", "string"), ("iid", "string"), ("father", "string"), ("mother", "string"), ("sex", "int"), ("phenotype", "double"))
    return id_list(lines(spark, path)).select(F.col("idx").alias("sample"), *[F.get(f, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(names)])


def bim(spark: SparkSession, path: str) -> DataFrame:
    """(snp, chrom, id, cm, pos, a1, a2) of a .bim file, snp from 0 in file order."""
    from kinforge.sources.text import id_list, lines

    f = F.split("id", r"\s+")
    names = (("chrom", "string"), ("name", "string"), ("cm", "double"), ("pos", "long"), ("a1", "string"), ("a2", "string"))
    rows = id_list(lines(spark, path)).select(F.col("idx").alias("snp"), *[F.get(f, F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(names)])
    return rows.withColumnRenamed("name", "id")


def decode_bed(raw: bytes, n_samples: int) -> np.ndarray:
    """Dosages (variant x sample) of whole two-bit records."""
    width = (n_samples + 3) // 4
    codes = np.frombuffer(raw, np.uint8).reshape(-1, width)
    two = (codes[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return BED_DOSAGE[two.reshape(len(codes), -1)[:, :n_samples]]


def encode_bed(dosage: np.ndarray) -> bytes:
    """The file for dosages (variant x sample)."""
    codes = np.select([np.isnan(dosage), dosage == 2, dosage == 1], [1, 0, 2], 3).astype(np.uint8)
    codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 4))).reshape(len(codes), -1, 4)
    return BED_MAGIC + (codes << np.array([0, 2, 4, 6], np.uint8)).sum(2).astype(np.uint8).tobytes()


def bed(spark: SparkSession, url: str, n_samples: int, n_snps: int, step: int = 2048) -> DataFrame:
    """Dosages of a variant-major .bed file; a file too short for its variants is an error."""
    width = (n_samples + 3) // 4

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(url) as file:
            if file.read(3) != BED_MAGIC:
                raise ValueError(f"{url}: not a variant-major bed file")
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    n = min(step, n_snps - at)
                    file.seek(3 + at * width)
                    raw = file.read(n * width)
                    if len(raw) < n * width:
                        raise ValueError(f"{url}: {n_snps} variants expected, the file is shorter")
                    yield _rows(at, decode_bed(raw, n_samples))

    return spark.range(0, n_snps, step).mapInArrow(read, ROWS)


def pgen(spark: SparkSession, url: str, n_samples: int, n_snps: int, step: int = 2048) -> DataFrame:
    """Dosages of the second allele from a fixed-width PLINK 2 file (storage mode 2): two bits a sample, code 3 missing."""
    width = (n_samples + 3) // 4
    table = np.array([0.0, 1.0, 2.0, np.nan])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(url) as file:
            head = file.read(12)
            if head[:2] != b"\x6c\x1b" or head[2] != 2:
                raise ValueError(f"{url}: storage mode {head[2:3]!r} is not fixed-width hard calls")
            if struct.unpack_from("<II", head, 3) != (n_snps, n_samples):
                raise ValueError(f"{url}: counts differ from its sample and variant files")
            for batch in batches:
                for at in batch.column(0).to_pylist():
                    n = min(step, n_snps - at)
                    file.seek(12 + at * width)
                    codes = np.frombuffer(file.read(n * width), np.uint8).reshape(n, width)
                    two = (codes[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
                    yield _rows(at, table[two.reshape(n, -1)[:, :n_samples]])

    return spark.range(0, n_snps, step).mapInArrow(read, ROWS)


def encode_pgen(dosage: np.ndarray) -> bytes:
    """Fixed-width hard calls for dosages (variant x sample) of the second allele."""
    codes = np.where(np.isnan(dosage), 3, np.nan_to_num(dosage)).astype(np.uint8)
    m, n = codes.shape
    codes = np.pad(codes, ((0, 0), (0, -n % 4))).reshape(m, -1, 4)
    return b"\x6c\x1b\x02" + struct.pack("<IIB", m, n, 0x40) + (codes << np.array([0, 2, 4, 6], np.uint8)).sum(2).astype(np.uint8).tobytes()


class Bgen:
    """Layout 2 of BGEN 1.2: header, sample ids, and the blocks of variants one after another."""

    def __init__(self, file):
        self.file = file
        offset, head, self.n_variants, self.n_samples = struct.unpack("<IIII", file.read(16))
        magic = file.read(4)
        if magic not in (b"bgen", b"\0\0\0\0"):
            raise ValueError("not a BGEN file")
        file.read(head - 20)
        flags = struct.unpack("<I", file.read(4))[0]
        self.compression, self.layout = flags & 3, (flags >> 2) & 15
        if self.layout != 2:
            raise ValueError(f"layout {self.layout} is not supported")
        self.ids = None
        if flags >> 31:
            _, n = struct.unpack("<II", file.read(8))
            self.ids = [self._text(2) for _ in range(n)]
        self.start = offset + 4

    def _text(self, width: int) -> str:
        return self.file.read(int.from_bytes(self.file.read(width), "little")).decode()

    def variant(self) -> tuple[dict, int, int]:
        """About the variant at the file's position, and where its data begin and how long they are."""
        name, rsid, chrom = self._text(2), self._text(2), self._text(2)
        pos, n_alleles = struct.unpack("<IH", self.file.read(6))
        alleles = [self._text(4) for _ in range(n_alleles)]
        length = struct.unpack("<I", self.file.read(4))[0]
        about = {"chrom": chrom, "id": rsid or name, "pos": pos, "alleles": alleles}
        return about, self.file.tell(), length

    def dosage(self, at: int, length: int) -> np.ndarray:
        """2 - 2 p0 - p1 of a biallelic, unphased, diploid variant; NaN where missing."""
        self.file.seek(at)
        raw = self.file.read(length)
        if self.compression:
            size, packed = struct.unpack_from("<I", raw)[0], raw[4:]
            if self.compression == 1:
                raw = zlib.decompress(packed)
            else:
                import zstandard

                raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=size)
        n, n_alleles, least, most = struct.unpack_from("<IHBB", raw)
        ploidy = np.frombuffer(raw, np.uint8, n, 8)
        phased, bits = raw[8 + n], raw[9 + n]
        if n_alleles != 2 or phased or (least, most) != (2, 2) or bits not in (8, 16):
            raise ValueError("only biallelic, unphased, diploid variants of 8 or 16 bits are supported")
        p = np.frombuffer(raw, f"<u{bits // 8}", 2 * n, 10 + n).reshape(n, 2) / (2**bits - 1)
        return np.where(ploidy & 0x80, np.nan, 2 - 2 * p[:, 0] - p[:, 1])


def bgen_samples(url: str) -> list[str] | None:
    with _open(url) as file:
        return Bgen(file).ids


def bgen(spark: SparkSession, url: str, step: int = 256) -> tuple[DataFrame, DataFrame]:
    """(variants, dosages) of the biallelic variants; a1 is the second allele, which dosages count. One task walks the variants' heads (they have no index of their own)
    and writes where each one's data lie; then ranges of ``step`` variants are decoded in parallel, a batch each."""
    from kinforge.tables import written

    about = "snp long, chrom string, id string, pos long, a1 string, a2 string, at long, length long"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            with _open(url) as file:
                source, rows = Bgen(file), []
                file.seek(source.start)
                for i in range(source.n_variants):
                    x, at, length = source.variant()
                    file.seek(at + length)
                    if len(x["alleles"]) == 2:
                        rows.append((i, x["chrom"], x["id"], x["pos"], *reversed(x["alleles"]), at, length))
                    if len(rows) == 4096:
                        yield _index_batch(rows)
                        rows = []
                if rows:
                    yield _index_batch(rows)

    found = written(spark.range(0, 1, 1, 1).mapInArrow(index, about), "bgen-index")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _open(url) as file:
            source = Bgen(file)
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    part = batch.slice(at, step)
                    x = np.stack([source.dosage(a, n) for a, n in zip(part.column("at").to_pylist(), part.column("length").to_pylist(), strict=True)])
                    flat = pa.array(x.ravel(), pa.float64(), from_pandas=True)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)
                    yield pa.RecordBatch.from_arrays([part.column("snp"), lists], ["snp", "dosage"])

    parts = max(1, -(-found.count() // step))
    rows = found.select("snp", "at", "length").repartitionByRange(parts, "snp").sortWithinPartitions("snp")
    return found.drop("at", "length"), rows.mapInArrow(read, ROWS)


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["snp", "chrom", "id", "pos", "a1", "a2", "at", "length"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _plink2(spark: SparkSession, path: str, default: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """(idx, f) of the lines of a .pvar or .psam file, and the places of its columns."""
    from kinforge.sources.text import id_list, lines

    rows = lines(spark, path).where(~F.col("text").startswith("##"))
    head = rows.where(F.col("text").startswith("#")).orderBy("line").limit(1).collect()
    names = head[0]["text"].lstrip("#").split() if head else default
    body = id_list(rows.where(~F.col("text").startswith("#")))
    return body.withColumn("f", F.split("id", r"\s+")), {n: i for i, n in enumerate(names)}


def psam(spark: SparkSession, path: str) -> DataFrame:
    """(sample, fid, iid) of a .psam file, sample from 0 in file order; without families the FID is 0."""
    rows, at = _plink2(spark, path, ["FID", "IID"])
    fid = F.get("f", F.lit(at["FID"])) if "FID" in at else F.lit("0")
    return rows.select(F.col("idx").alias("sample"), fid.alias("fid"), F.get("f", F.lit(at["IID"])).alias("iid"))


def pvar(spark: SparkSession, path: str) -> DataFrame:
    """(snp, chrom, id, pos, a1, a2) of a .pvar file, snp from 0 in file order; a1 is ALT, the allele that dosages count."""
    rows, at = _plink2(spark, path, ["CHROM", "ID", "CM", "POS", "ALT", "REF"])
    cols = (("CHROM", "chrom", "string"), ("ID", "id", "string"), ("POS", "pos", "long"), ("ALT", "a1", "string"), ("REF", "a2", "string"))
    return rows.select(F.col("idx").alias("snp"), *[F.get("f", F.lit(at[c])).try_cast(t).alias(f"{n}__") for c, n, t in cols]).toDF("snp", *[n for _, n, _ in cols])


def long(variants: DataFrame) -> DataFrame:
    """(snp, sample, dosage) rows."""
    if dict(variants.dtypes)["dosage"] == "binary":
        from kinforge.operators.genotypes import blocks, packed_batch

        variants = variants.select("snp", "dosage").mapInArrow(lambda batches: (packed_batch(part.column("snp"), x) for part, x in blocks(batches)), "snp long, dosage array<double>")
    return variants.select("snp", F.posexplode("dosage").alias("sample", "dosage")).select("snp", F.col("sample").cast("long"), "dosage")
