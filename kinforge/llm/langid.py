"""Language identification by rank-order profiles of character n-grams.

A profile lists the ``depth`` most frequent n-grams (1 to 3 letters, with word boundaries in 2- and 3-grams) in
order. A document's own list is compared with each language's: an n-gram costs how far out of place it is, or
``depth`` if the profile lacks it. The language with the least sum is predicted; its score is 1 less the sum's
share of the greatest possible sum.

Profiles count all training documents, summed in Spark; ties in frequency go by the n-gram's code.
Null texts, and texts without a letter, are ``und`` with score 0, and so is every text if nothing could be learned.
Of languages with equal sums the first in code-point order is predicted. Texts of any length are read whole. Rows with
null ids are ordinary rows; repeated rows count repeatedly; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinforge.llm.common import column, pieces

#: Stands for a word boundary within an n-gram's code; letters are code points, below it.
EDGE = np.int64((1 << 21) - 1)
CHUNK = 1 << 20
#: Code points of short texts that are counted together: some 100 bytes of memory each.
RUN = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text between edges, everything but letters an edge, edges never doubled."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    codes[~_letters()[codes]] = EDGE
    return codes[np.concatenate(([True], (codes[1:] != EDGE) | (codes[:-1] != EDGE)))]


def _grams(s: np.ndarray) -> np.ndarray:
    """Codes of the n-grams; the ranges of 1-, 2- and 3-grams don't meet."""
    two = (s[:-1] << 21) | s[1:]
    return np.concatenate((s[s != EDGE], two, ((two[:-1] << 21) | s[2:])[s[1:-1] != EDGE]))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of the whole text in order of code, and how often each occurs."""
    s = _symbols(text)
    if len(s) < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if len(s) <= CHUNK:
        return np.unique(_grams(s), return_counts=True)
    parts = [np.unique(_grams(s[at : at + CHUNK + 2]), return_counts=True) for at in range(0, len(s), CHUNK)]
    # neighbouring chunks share two symbols, whose 1-grams and one 2-gram are counted twice
    for at in range(CHUNK, len(s), CHUNK):
        twice = s[at : at + 2]
        extra = [twice[twice != EDGE]] + ([np.array([(twice[0] << 21) | twice[1]])] if len(twice) == 2 else [])
        keys, n = np.unique(np.concatenate(extra), return_counts=True)
        parts.append((keys, -n))
    return _summed(parts)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all parts in order, and their sums above 0."""
    keys = np.concatenate([k for k, _ in parts])
    values, at = np.unique(keys, return_inverse=True)
    totals = np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)
    return values[totals > 0], totals[totals > 0]


def counted_together(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all the texts; a few texts at a time, so memory doesn't grow with their number."""
    parts, run, size = [], [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= RUN:
            parts.append(counted("\n".join(run)))
            run, size = [], 0
    if run or not parts:
        parts.append(counted("\n".join(run)))
    return _summed(parts) if len(parts) > 1 else parts[0]


def ranked(keys: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """The ``depth`` most frequent n-grams, most frequent first, ties by code."""
    if len(keys) > 4 * depth:
        least = np.partition(counts, len(counts) - depth)[len(counts) - depth]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.argsort(-counts, kind="stable")[:depth]]


def learn(docs: DataFrame, depth: int = 300) -> DataFrame:
    """Profiles (lang, gram, place) of the documents with a lang; place counts from 0."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096, release=True):
            by_lang: dict[str, list[str]] = {}
            for text, lang in zip(column(batch, "text"), column(batch, "lang"), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                keys, n = counted_together(texts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "gram", "n"])

    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    sums = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")) - 1
    return sums.select("lang", "gram", place.alias("place")).where(F.col("place") < depth)


class Profiles:
    """All profiles side by side: a row of places for each n-gram that any has."""

    def __init__(self, rows: list[tuple[str, int, int]], depth: int):
        self.depth, self.langs = depth, sorted({lang for lang, _, _ in rows})
        self.grams = np.unique(np.array([g for _, g, _ in rows], np.int64))
        self.places = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for lang, gram, place in rows:
            self.places[np.searchsorted(self.grams, gram), self.langs.index(lang)] = place

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        own = ranked(*counted(text), self.depth)
        if not len(own):
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = -1
        places = self.places[at]
        off = np.where(places < 0, self.depth, np.abs(places - np.arange(len(own))[:, None])).sum(0)
        best = int(off.argmin())
        return self.langs[best], float(1 - off[best] / (self.depth * len(own)))


#: Languages that a model may have: profiles of this many still fit in a few MB.
MAX_LANGS = 1000


def predict(docs: DataFrame, profiles: DataFrame, depth: int = 300, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The documents' columns with the predicted language and its score, under ``names`` that they don't have."""
    if clash := {n.lower() for n in names} & {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents have columns {sorted(clash)}")
    rows = [tuple(r) for r in profiles.limit(MAX_LANGS * depth + 1).collect()]
    if len(rows) > MAX_LANGS * depth:
        raise ValueError(f"more than {MAX_LANGS} languages")
    model = docs.sparkSession.sparkContext.broadcast(Profiles(rows, depth))
    at = [c.lower() for c in docs.columns].index("text")

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, release=True):
            out = [model.value.predict(t) for t in batch.column(at).to_pylist()]
            more = [pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(guess, schema)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, mod ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def identify(docs: DataFrame, depth: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from the documents whose fold of 4 isn't 2."""
    profiles = learn(docs.where(fold(F.col("doc_id"), 4) != 2), depth)
    rows = docs.select("doc_id", "text", (fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    return predict(rows, profiles, depth).select("doc_id", "held_out", "lang_pred", "score")
