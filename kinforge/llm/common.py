"""Shared pieces: word splitting, shared-folder tables, batch helpers."""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a word: digits, letters and everything beyond ASCII; A-Z becomes a-z, the rest a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Lower-cases A-Z and leaves the other bytes alone.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

MASK64 = (1 << 64) - 1


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").translate(WORD_TABLE).split() if text else []


def tokens_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").translate(LOWER_TABLE).split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class WordHasher:
    """Stable 64-bit hashes of words, remembered per process up to ``limit`` words."""

    def __init__(self, limit: int = 500_000):
        self.limit, self.seen = limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        seen = self.seen
        if len(seen) > self.limit:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a local one only in local sessions without it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file:///tmp/checkpoints/kinforge"
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written within go when the block ends, unless written to stay (until a block around it ends): what
    follows must not read them."""
    _SCRATCH.append(paths := [])
    try:
        yield
    finally:
        _SCRATCH.remove(paths)
        for path in paths:
            delete(spark, path)


#: Rows of a file, of tables whose rows are keys and numbers, and of those with whole texts.
FILE_ROWS, FILE_TEXTS = 20_000, 2_000


def few_files(df: DataFrame, rows: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """The frame of at most ``rows`` rows in no more partitions than they fill, but one for each core at least.

    A shuffle has the same number of partitions for a small table, and a file system without Hadoop's native library
    starts two processes from the executor's JVM for each file that it writes.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // file_rows)))


def written(df: DataFrame, name: str, stays: bool = False, rows: int | None = None) -> DataFrame:
    """The rows, written once as a table in the shared folder and read from there: lineage ends here.

    ``rows``: a bound of their number, if known before."""
    if rows is not None:
        df = few_files(df, rows)
    path = shared_path(df.sparkSession, name)
    if len(_SCRATCH) > stays:
        _SCRATCH[-1 - stays].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, in any case of letters."""
    taken = {c.lower() for f in frames for c in f.columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def hashable(df: DataFrame, *names: str) -> list[Column]:
    """The columns in a form that Spark's hashes take: maps as text."""
    return [F.to_json(df[c]) if "map<" in df.schema[c].dataType.simpleString() else df[c] for c in names]


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished jobs now: it does so when the driver's garbage is collected, and that
    of Python first, which holds on to the JVM's."""
    for _ in range(2):  # what the last query leaves behind may become garbage only after a moment
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def open_fs(url: str):
    """pyarrow file system and path of a URL (local paths too); works on executors."""
    from pyarrow import fs

    if "://" in url or url.startswith("file:"):
        url = "file://" + url[5:] if url.startswith("file:/") and not url.startswith("file://") else url
        return fs.FileSystem.from_uri(url)
    return fs.LocalFileSystem(), url


def arrow_schema(ddl_type: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ddl_type)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_pylist()


def release_memory() -> None:
    """Gives free memory back to the system: Arrow and the C library keep it otherwise, and a worker of one task waits
    with it for the next one's, while the executor's JVM needs it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512, release: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that whole texts of one slice fit well in a worker; ``release``: what is
    free after the last one goes back to the system."""
    try:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield batch.slice(at, rows)
    finally:
        if release:
            batch = None
            release_memory()


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
