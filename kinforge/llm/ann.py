"""Nearest neighbours by anisotropic product quantisation, four-bit table scans and exact reranking.

Vectors are scaled to unit length, so the inner product is the cosine. A vector is cut into subspaces of
``width`` components, each coded by one of 16 centres (four bits, two codes a byte). Codes and centres minimise a
score-aware loss: for maximum inner product the part of the residual parallel to the vector matters more than the
orthogonal part, by the factor eta = (d - 1) t^2 / (1 - t^2) for scores above t. Centres are fitted by
alternating coordinate descent on a bounded sample (``fit_rows`` rows with the smallest hashes); every row is
indexed.

Codes are packed with their vectors into blocks of at most ``block_rows`` rows and ``block_bytes`` bytes of vectors and
meet the queries in blocks of ``query_rows``. A task adds up 256-entry tables (pairs of four-bit tables) for each query
over a code block. From that score and the stored angle between a vector and its code follows the most the vector's
cosine can be; every vector that can still reach the k-th best of the block is reranked with the exact cosine of the
original vectors in double precision, ties to the smaller id. No shortlist of fixed size is cut: codes only say what
need not be read, so equal codes are reranked whole, and the result is the exact one. The k best of all blocks are
merged.

Null vectors, zero vectors and those holding null or non-finite components take no part, nor do rows with a null
id or another dimension than most usable rows of the sample have. A repeated id counts once, with its best score.
Fewer candidates than k give fewer rows; an empty table gives none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinforge.llm.common import column, written

CENTRES = 16


@dataclass
class Codebook:
    """Centres (subspace, centre, component) of equally wide subspaces; the vectors are padded with zeros."""

    centres: np.ndarray
    dim: int
    eta: float

    def pad(self, x: np.ndarray) -> np.ndarray:
        m, _, w = self.centres.shape
        return np.pad(x, ((0, 0), (0, m * w - x.shape[1]))) if m * w > x.shape[1] else x

    def encode(self, unit: np.ndarray, rounds: int = 3) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, from the nearest centres."""
        x = self.pad(unit)
        n, (m, _, w) = len(x), self.centres.shape
        parts = x.reshape(n, m, w)
        # squared distance and parallel error of each choice
        dist = np.stack([((parts[:, j, None, :] - self.centres[j]) ** 2).sum(-1) for j in range(m)], 1)
        along = np.stack([((parts[:, j, None, :] - self.centres[j]) * parts[:, j, None, :]).sum(-1) for j in range(m)], 1)
        codes = dist.argmin(-1)
        rows = np.arange(n)
        total = np.take_along_axis(along, codes[..., None], -1)[..., 0].sum(1)
        for _ in range(rounds):
            changed = False
            for j in range(m):
                others = total - along[rows, j, codes[:, j]]
                loss = dist[:, j] + (self.eta - 1) * (others[:, None] + along[:, j]) ** 2
                best = loss.argmin(-1)
                changed |= bool((best != codes[:, j]).any())
                codes[:, j] = best
                total = others + along[rows, j, best]
            if not changed:
                break
        return codes.astype(np.uint8)

    def angles(self, unit: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(row, 3): one over the length of each row's coded vector (0 if it has none), cosine and sine of the angle to it."""
        x = self.pad(unit)
        coded = self.centres[np.arange(codes.shape[1]), codes].reshape(len(x), -1)
        length = np.sqrt((coded * coded).sum(1))
        inverse = np.divide(1.0, length, out=np.zeros_like(length), where=length > 1e-6)
        cosine = np.clip((coded * x).sum(1) * inverse, -1, 1)
        return np.stack([inverse, cosine, np.sqrt(1 - cosine**2)], 1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Four-bit tables (query, subspace, centre)."""
        q = self.pad(queries)
        m, _, w = self.centres.shape
        return np.einsum("qmw,mcw->qmc", q.reshape(len(q), m, w), self.centres)


def fit(unit: np.ndarray, width: int = 2, threshold: float = 0.2, rounds: int = 4, seed: int = 7) -> Codebook:
    """Alternates coding and, for fixed codes, the exact least squares of the anisotropic loss."""
    n, dim = unit.shape
    m = -(-dim // width)
    m += m % 2
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(seed)
    book = Codebook(np.zeros((m, CENTRES, width)), dim, eta)
    x = book.pad(unit)
    parts = x.reshape(n, m, width)
    for j in range(m):
        book.centres[j] = parts[rng.choice(n, CENTRES, replace=n < CENTRES), j]
        for _ in range(6):  # plain k-means to start with
            own = ((parts[:, j, None] - book.centres[j]) ** 2).sum(-1).argmin(-1)
            for c in range(CENTRES):
                if (mine := own == c).any():
                    book.centres[j, c] = parts[mine, j].mean(0)
    size = m * CENTRES * width
    for _ in range(rounds):
        codes = book.encode(unit)
        # loss = |x - Sc|^2 + (eta - 1) (x'(x - Sc))^2, with S the selection by the codes
        columns = ((np.arange(m) * CENTRES + codes)[:, :, None] * width + np.arange(width)).reshape(n, m * width)
        a, b = np.zeros((size, size)), np.zeros(size)
        a[np.diag_indices(size)] += np.bincount(columns.ravel(), minlength=size)
        np.add.at(b, columns, x * eta)
        for at in range(0, n, 2048):
            wide = np.zeros((len(x[at : at + 2048]), size))
            np.put_along_axis(wide, columns[at : at + 2048], x[at : at + 2048], 1)
            a += (eta - 1) * (wide.T @ wide)
        a[np.diag_indices(size)] += 1e-6
        fitted = np.linalg.solve(a, b + 1e-6 * book.centres.ravel()).reshape(book.centres.shape)
        book.centres = fitted
    return book


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part, components as doubles."""
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = F.exists("embedding", lambda v: v != 0)
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad & some)


def raws(batch: pa.RecordBatch, name: str = "embedding", dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and vectors of the rows with ``dim`` components."""
    lists = batch.column(name)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(lengths == dim)
    return keep, lists.take(pa.array(keep)).flatten().to_numpy(zero_copy_only=False).reshape(len(keep), dim)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row divided by a power of two: no overflow in the squares, and cosines stay the same to the bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def to_unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def first_of(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best, ties to the smaller id, of each id the best one only."""
    order = np.lexsort((ids, -score))
    return order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    fit_rows: int = 6144,
    block_rows: int = 16384,
    query_rows: int = 512,
    width: int = 2,
    threshold: float = 0.2,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of every query (vec_id, embedding) but its own id."""
    spark = vectors.sparkSession
    base, asked = usable(vectors), usable(queries)
    hashed = F.xxhash64("vec_id", F.lit(17))
    sample = [r[0] for r in base.orderBy(hashed, "vec_id").select("embedding").limit(fit_rows).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lengths = [len(v) for v in sample]
    dim = max(set(lengths), key=lambda d: (lengths.count(d), d))
    book = spark.sparkContext.broadcast(fit(to_unit(np.array([v for v in sample if len(v) == dim])), width, threshold))
    # vectors stay in the blocks as they are given
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    full = max(1, min(block_rows, block_bytes // (dim * int(kind[2]))))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = 0, []

        def block() -> pa.RecordBatch:
            ids, codes, angles, raw = (np.concatenate(c) for c in zip(*parts, strict=True))
            packed = codes[:, 0::2] | codes[:, 1::2] << 4
            cols = [pa.array([c.tobytes()], pa.binary()) for c in (ids.astype("<i8"), packed, angles.astype("<f4"), raw.astype(kind))]
            return pa.RecordBatch.from_arrays(cols, ["ids", "codes", "angles", "raw"])

        for batch in batches:
            step = min(2048, full)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                keep, raw = raws(part, dim=dim)
                if len(keep):
                    unit = to_unit(raw)
                    codes = book.value.encode(unit)
                    parts.append((part.column("vec_id").to_numpy()[keep], codes, book.value.angles(unit, codes), raw))
                    held += len(keep)
                if held >= full:
                    yield block()
                    held, parts = 0, []
        if held:
            yield block()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, query_rows):
                part = batch.slice(at, query_rows)
                keep, raw = raws(part, dim=dim)
                if len(keep):
                    ids = part.column("vec_id").to_numpy()[keep]
                    cols = [pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([raw.astype("<f8").tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, ["q_ids", "q_raw"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("ids", "codes", "angles", "raw", "q_ids", "q_raw")
        for batch in batches:
            for at in range(batch.num_rows):
                ids, codes, angles, raw, q_ids, q_raw = (batch.column(c)[at].as_buffer() for c in names)
                ids, q_ids = np.frombuffer(ids, "<i8"), np.frombuffer(q_ids, "<i8")
                packed = np.ascontiguousarray(np.frombuffer(codes, np.uint8).reshape(len(ids), -1).T)
                inverse, cosine, sine = np.ascontiguousarray(np.frombuffer(angles, "<f4").reshape(len(ids), 3).T)
                v = scaled(np.frombuffer(raw, kind).astype("<f8").reshape(len(ids), dim))
                lengths = np.sqrt((v * v).sum(1))
                asks = scaled(np.frombuffer(q_raw, "<f8").reshape(len(q_ids), dim))
                tables = book.value.tables(to_unit(asks)).astype(np.float32)
                slack = np.float32(1e-6 * tables.shape[1])  # more than sums of single precision can be off
                out_q, out_v, out_s = [], [], []
                for q, ask_of, table in zip(q_ids, asks, tables, strict=True):
                    pairs = (table[1::2, :, None] + table[0::2, None, :]).reshape(len(packed), 256)
                    rough = np.zeros(len(ids), np.float32)
                    for row, codes_of in zip(pairs, packed, strict=True):
                        rough += row[codes_of]
                    # the angle to a vector is at least that to its code less that between code and vector
                    near = np.minimum((rough + slack) * inverse, 1)
                    most = near * cosine + np.sqrt(np.maximum(1 - near * near, 0)) * sine + np.float32(1e-5)
                    most[near >= cosine - np.float32(1e-5)] = 2
                    most[inverse == 0] = 2
                    most[ids == q] = -np.inf
                    length = np.sqrt((ask_of * ask_of).sum())

                    def exact(rows, ask_of=ask_of, length=length):
                        return (ask_of * v[rows]).sum(1) / (length * lengths[rows])

                    some = np.argpartition(most, -8 * k)[-8 * k :] if len(ids) > 8 * k else np.arange(len(ids))
                    some = some[most[some] > -np.inf]
                    score = exact(some)
                    top = first_of(ids[some], score, k)
                    least = score[top[-1]] if len(top) == k else -2.0
                    rows = np.flatnonzero(most >= least - 1e-9)
                    score = exact(rows)
                    top = first_of(ids[rows], score, k)
                    out_q.append(np.full(len(top), q))
                    out_v.append(ids[rows[top]])
                    out_s.append(score[top])
                cols = [np.concatenate(out_q), np.concatenate(out_v), np.concatenate(out_s)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "vec_id", "score"])

    rows = base.select("vec_id", "embedding")
    code_blocks = written(rows.mapInArrow(encode, "ids binary, codes binary, angles binary, raw binary"), "ann-codes")
    query_blocks = written(asked.mapInArrow(ask, "q_ids binary, q_raw binary"), "ann-queries")
    # a stated set of queries against all rows, block by block
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    met = code_blocks.repartition(n).crossJoin(query_blocks)
    scored = met.mapInArrow(scan, "query_id long, vec_id long, score double")
    scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The ``k`` nearest of each row whose vec_id is divisible by ``every``, among all other rows."""
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)
