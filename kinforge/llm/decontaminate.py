"""Benchmark decontamination with a Wu-Manber search over words.

A window is ``size`` consecutive words of a benchmark item; an item of fewer words (but not none) is one window.
Windows of one length form a search: a block of two words (one, for windows of one word) selects a shift from a
table, so that the scan jumps over positions where no window can end; where the shift is 0, the block's bucket
names the windows that end so, and comparing their words with the text's confirms or refutes each.

The benchmark is cut into portions of about ``portion_bytes`` of text, each a file in the shared folder, so that
neither the driver nor a broadcast ever holds all of it. One narrow pass over the documents, without a shuffle, reads
them all: a worker keeps the tables of up to ``KEPT`` portions as long as it lives. Beyond that many it goes through
the portions for every ``BLOCK_BYTES`` of texts, with one portion's tables at a time.

Null or empty texts have no words; texts of any length are read whole; items with a null id take no part; rows that
repeat an item count as one item, rows that repeat a document are documents of their own. An empty table of documents
gives no rows, an empty benchmark no hits. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.common import open_fs, pieces, shared_path, words_of

TABLE_BITS = 18
#: Portions whose tables a worker keeps; bytes of texts that meet all portions together beyond that.
KEPT, BLOCK_BYTES = 8, 64 << 20


class WuManber:
    """Search for windows of one length ``m`` (in words)."""

    def __init__(self, m: int, windows: list[tuple[list[bytes], int, str]], hasher):
        self.m, self.block = m, min(2, m)
        reach = m - self.block + 1
        shift = np.full(1 << TABLE_BITS, min(255, reach), np.uint8)
        self.buckets: dict[int, list[tuple[list[bytes], int, str]]] = {}
        for words, at, item in windows:
            keys = self.keys(hasher(words[at : at + m])).tolist()
            for end, key in enumerate(keys):
                shift[key] = min(shift[key], min(255, len(keys) - 1 - end))
            self.buckets.setdefault(keys[-1], []).append((words, at, item))
        self.shift = shift

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """Table positions of the blocks that end at each word from the ``block``-th on."""
        h = hashes * np.uint64(0x9E3779B97F4A7C15)
        if self.block == 2:
            h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:]
        return h >> np.uint64(64 - TABLE_BITS)

    def find(self, words: list[bytes], hashes: np.ndarray) -> Iterator[tuple[int, str]]:
        """(first word, item) of each occurrence."""
        m, n = self.m, len(words)
        if n < m:
            return
        keys = self.keys(hashes)
        shifts = self.shift[keys]
        if m < 4:
            ends = np.flatnonzero(shifts == 0).tolist()
        else:
            ends, jumps, at, last = [], shifts.tobytes(), m - self.block, len(shifts)
            while at < last:
                jump = jumps[at]
                if jump:
                    at += jump
                else:
                    ends.append(at)
                    at += 1
        for end in ends:
            start = end + self.block - m
            if start < 0:
                continue
            here = words[start : start + m]
            for other, at, item in self.buckets.get(int(keys[end]), ()):
                if other[at] == here[0] and other[at : at + m] == here:
                    yield start, item


class Searcher:
    """All windows of the items, grouped by length."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        from kinforge.llm.common import WordHasher

        self.hasher = WordHasher()
        by_length: dict[int, dict] = {}
        for item, text in items:
            words = words_of(text)
            m = min(size, len(words))
            for at in range(len(words) - m + 1 if words else 0):
                by_length.setdefault(m, {}).setdefault((item, b" ".join(words[at : at + m])), (words, at, item))
        self.searches = [WuManber(m, list(w.values()), self.hasher) for m, w in sorted(by_length.items())]

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words any occurrence covers, and the items that occur."""
        hit, items = np.zeros(len(words), bool), set()
        if words and self.searches:
            hashes = self.hasher(words)
            for search in self.searches:
                for start, item in search.find(words, hashes):
                    hit[start : start + search.m] = True
                    items.add(item)
        return hit, items


def _portions(benchmark: DataFrame, portion_bytes: int) -> list[str]:
    """Writes the distinct items (id, text) in portions; their paths."""
    folder = shared_path(benchmark.sparkSession, "benchmark")
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string"), "text").distinct()
    portion, used, paths = [], 0, []

    def finish() -> None:
        fs, inner = open_fs(f"{folder}/{len(paths)}")
        fs.create_dir(inner.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(inner) as out:
            out.write(pickle.dumps(portion))
        paths.append(f"{folder}/{len(paths)}")

    for item, text in rows.toLocalIterator():
        size = len(text.encode("utf-8", "replace"))
        if portion and used + size > portion_bytes:
            finish()
            portion, used = [], 0
        portion.append((item, text))
        used += size
    if portion:
        finish()
    return paths


def _load(path: str, size: int) -> Searcher:
    fs, inner = open_fs(path)
    with fs.open_input_stream(inner) as file:
        return Searcher(pickle.loads(file.read()), size)


_kept = lru_cache(maxsize=KEPT)(_load)


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about ``most`` bytes."""
    held, used = [], 0
    for batch in pieces(batches):
        held.append(batch)
        used += batch.nbytes
        if used >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, used = [], 0
    if held and any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _scanned(batches: Iterator[pa.RecordBatch], at: int, paths: list[str], size: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, set[str]]]]]:
    """Batches, and for each row the hit words and the items found; ``at`` is the place of the texts' column."""
    if len(paths) <= KEPT:
        searchers = [_kept(p, size) for p in paths]
        for batch in pieces(batches):
            found = []
            for text in batch.column(at).to_pylist():
                words = words_of(text)
                hit, items = np.zeros(len(words), bool), set()
                for searcher in searchers:
                    more, names = searcher.scan(words)
                    hit |= more
                    items |= names
                found.append((hit, items))
            yield batch, found
        return
    for batch in _blocks(batches, BLOCK_BYTES):
        texts = batch.column(at).to_pylist()
        found = [(np.zeros(len(words_of(t)), bool), set()) for t in texts]
        for path in paths:
            searcher = _load(path, size)
            for text, (hit, items) in zip(texts, found, strict=True):
                more, names = searcher.scan(words_of(text))
                hit |= more
                items |= names
        yield batch, found


def scan_documents(docs: DataFrame, benchmark: DataFrame, size: int = 10, portion_bytes: int = 4 << 20) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, items (sorted array of item ids), hits (bit per word)."""
    paths = _portions(benchmark, portion_bytes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scanned(batches, 1, paths, size):
            cols = [
                batch.column(0),
                pa.array([len(hit) for hit, _ in found], pa.int64()),
                pa.array([int(hit.sum()) for hit, _ in found], pa.int64()),
                pa.array([sorted(items) for _, items in found], pa.list_(pa.string())),
                pa.array([np.packbits(hit).tobytes() if items else b"" for hit, items in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_hit", "items", "hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, n_words long, n_hit long, items array<string>, hits binary")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan_documents(docs, benchmark, size)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, portion_bytes: int = 4 << 20) -> DataFrame:
    """The documents without a hit word, with all their columns."""
    paths, at = _portions(benchmark, portion_bytes), [c.lower() for c in docs.columns].index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scanned(batches, at, paths, size):
            yield batch.filter(pa.array([not items for _, items in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


CONTAMINATION_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (
  SELECT item_id::VARCHAR AS item,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
im AS (SELECT item, w, least(10, len(w)) AS m FROM iw WHERE len(w) > 0),
win AS (
  SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM im)),
dg AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS s
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM dw, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
occ AS (SELECT DISTINCT r, item, m, i FROM dg JOIN win USING (m, s)),
hit AS (SELECT r, count(DISTINCT p)::BIGINT AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM occ) GROUP BY r),
its AS (SELECT r, count(*)::BIGINT AS n, string_agg(item, ',' ORDER BY encode(item)) AS s FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items,
  sha256(coalesce(its.s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
