"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

A document's set holds its runs of ``size`` consecutive words (as 64-bit hashes); a text of fewer words, but not
none, is one run. Texts with equal sets are one node with a number of copies; all further work is on nodes.

1. Signatures: ``rows`` x ``bands`` minimum hashes, chosen so that a pair at the threshold shares a band with the
   target probability. Nodes meet by shuffling on band hashes.
2. Buckets of up to ``hot`` nodes yield candidate pairs; pairs whose whole signatures agree too little are
   dropped (6 standard deviations below the threshold: a pair at the threshold goes with a probability below 2e-7,
   by Chernoff's bound for 304 hashes, next to the 1e-3 of the bands). Larger buckets yield one edge a node, to their
   smallest.
3. Connected components of these edges bring together whatever may be similar. A component's nodes are dealt into
   blocks of about ``block`` nodes with sets of like size, and every pair of blocks whose sizes allow a link is one
   unit of work. There all pairs are verified on the full sets: those that share none of the rarest n-grams that a
   linked pair must share (prefix filter) at once, the others by counting. A unit returns a count of links for each
   node and a spanning star for each group, never the pairs.
4. Components of the verified links are the classes.

A row is known by its doc_id and a hash of its text. Null texts and texts without words are classes of their own,
without links. The class is named by the smallest doc_id of its members. Null ids are ordinary (they never name a
class that has another id); rows that repeat a document are copies of it, and of rows with one id but different texts
each is a document of its own. Texts of any length are read whole. An empty table gives no rows. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinforge.llm.common import FILE_TEXTS, WordHasher, column, few_files, mix64, pieces, scratch, unused, words_of, written
from kinforge.llm.components import components

BLOCK, HOT = 256, 64
#: Keys with more rows than one in so many of all are joined by a broadcast: there can't be more such keys than this.
HEAVY = 10_000
#: Blocks of a class of sizes.
SUB = 1 << 32


def banding(threshold: float, recall: float = 0.999, most_bands: int = 40) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose number of bands for the recall stays within ``most_bands``."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)), 1)
    for rows in range(2, 33):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands > most_bands:
            break
        best = (bands, rows)
    return best


def shingles(words: list[bytes], size: int, hasher: WordHasher) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of the whole text if it has fewer."""
    if not words:
        return np.empty(0, np.uint64)
    h = hasher(words)
    m = min(size, len(words))
    run = np.full(len(h) - m + 1, m, np.uint64)
    for i in range(m):
        run = run * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - m + 1 + i]
    return np.unique(mix64(run))


class Signer:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20240229)
        self.bands, self.rows = bands, rows
        self.factors = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, grams: np.ndarray) -> tuple[np.ndarray, bytes]:
        """Band hashes, and the low bytes of all minimum hashes."""
        least = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(grams), 2048):
            np.minimum(least, np.multiply.outer(self.factors, grams[at : at + 2048]).min(1), out=least)
        least = mix64(least)
        key = np.arange(self.bands, dtype=np.uint64)
        for row in least.reshape(self.bands, self.rows).T:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + row)
        return key.view(np.int64), least.astype(np.uint8).tobytes()


def set_key(grams: np.ndarray) -> bytes:
    return hashlib.md5(grams.tobytes()).digest()


def _signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, signer = WordHasher(), Signer(bands, rows)
        for batch in pieces(batches, release=True):
            keys, hashes, signatures, sizes = [], [], [], []
            for text in column(batch, "text"):
                grams = shingles(words_of(text), size, hasher)
                band, signature = signer(grams) if len(grams) else (None, None)
                keys.append(set_key(grams) if len(grams) else None)
                hashes.append(band)
                signatures.append(signature)
                sizes.append(len(grams))
            cols = [batch.column("doc_id"), batch.column("mark"), pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(signatures, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "mark", "key", "bands", "signature", "n"])

    schema = f"doc_id {kind}, mark long, key binary, bands array<long>, signature binary, n long"
    return _marked(docs).mapInArrow(sign, schema)


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text): id and mark tell rows apart, but for those that repeat a document."""
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")


def _candidates(nodes: DataFrame, threshold: float, members_at_most: int) -> DataFrame:
    """Edges (a, b) whose components hold every pair that shares a band (and may reach the threshold)."""
    members = nodes.select("key", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("hub")).where("n > 1")
    met = written(members.join(sizes, "bucket"), "near-buckets", rows=members_at_most)
    star = met.where((F.col("n") > HOT) & (F.col("key") != F.col("hub"))).select(F.col("key").alias("a"), F.col("hub").alias("b"))
    hot = written(components(star, "near-hot"), "near-hot-groups")
    cold = met.where(F.col("n") <= HOT).select("bucket", "key").join(hot.withColumnRenamed("node", "key"), "key", "left")
    left = cold.select("bucket", F.col("key").alias("a"), F.col("root").alias("ra"))
    right = cold.select("bucket", F.col("key").alias("b"), F.col("root").alias("rb"))
    # pairs within a large bucket's component are verified with it anyway
    apart = F.col("ra").isNull() | F.col("rb").isNull() | (F.col("ra") != F.col("rb"))
    pairs = left.join(right, "bucket").where((F.col("a") < F.col("b")) & apart).select("a", "b").distinct()
    own = nodes.select("key", "signature")
    pairs = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(column(batch, c)), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            least = threshold - 6 * math.sqrt(threshold * (1 - threshold) / sa.shape[1])
            keep = pa.array((sa == sb).mean(1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return hot.where("node <> root").toDF("a", "b").union(pairs.mapInArrow(agree, "a binary, b binary"))


def linked(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix (first x second) of the pairs whose Jaccard similarity reaches the threshold, on full sets.

    Linked sets share at least ``threshold`` of either one's n-grams, so of each one's n-grams in order of rarity the
    first (1 - threshold) and one more must have one in common; only such pairs are counted in full.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    ids = rank[ids]
    ids = ids[np.lexsort((ids, np.repeat(np.arange(len(sets)), sizes)))]
    begins = np.cumsum(sizes) - sizes
    heads = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
    mark = np.zeros(len(often), np.int32)
    flat = np.concatenate([ids[begins[j] : begins[j] + sizes[j]] for j in second])
    starts = np.cumsum(sizes[second]) - sizes[second]
    front = np.concatenate([ids[begins[j] : begins[j] + heads[j]] for j in second])
    front_starts = np.cumsum(heads[second]) - heads[second]
    out = np.zeros((len(first), len(second)), bool)
    for row, i in enumerate(first):
        own = ids[begins[i] : begins[i] + sizes[i]]
        mark[own[: heads[i]]] = 1
        near = np.flatnonzero(np.add.reduceat(mark[front], front_starts))
        mark[own] = 1
        if 2 * len(near) > len(second):
            common = np.add.reduceat(mark[flat], starts)[near]
        else:
            common = np.array([np.count_nonzero(mark[flat[starts[j] : starts[j] + sizes[second[j]]]]) for j in near], np.int64)
        mark[own] = 0
        out[row, near] = common >= threshold * (sizes[i] + sizes[second[near]] - common) - 1e-9
    return out


def _verify(units: DataFrame, threshold: float) -> DataFrame:
    """Rows (key, links, null) with copies of linked nodes, and (key, null, other) with an edge of a spanning star."""

    def verify(table: pa.Table) -> pa.Table:
        keys, grams = table["key"].to_pylist(), table["grams"].to_pylist()
        copies = table["copies"].to_numpy()
        block, low, high = (table[c].to_numpy() for c in ("block", "low", "high"))
        by_root: dict[bytes, dict[bytes, int]] = {}
        for at, (root, key) in enumerate(zip(table["root"].to_pylist(), keys, strict=True)):
            by_root.setdefault(root, {}).setdefault(key, at)
        out: list[tuple] = []
        for members in by_root.values():
            at = np.fromiter(members.values(), np.int64, len(members))
            sets = [np.frombuffer(grams[i], np.uint64) for i in at]
            same = low[at[0]] == high[at[0]]
            first = np.arange(len(at)) if same else np.flatnonzero(block[at] == low[at[0]])
            second = first if same else np.flatnonzero(block[at] == high[at[0]])
            if not len(first) or not len(second):
                continue
            match = linked(sets, first, second, threshold)
            if same:
                np.fill_diagonal(match, False)
            links = np.zeros(len(at), np.int64)
            links[first] += match @ copies[at][second]
            if not same:
                links[second] += copies[at][first] @ match
            out += [(keys[at[i]], int(links[i]), None) for i in np.flatnonzero(links)]
            left = set(np.flatnonzero(links).tolist())
            whole = np.zeros((len(at), len(at)), bool)
            whole[np.ix_(first, second)] = match
            whole |= whole.T
            while left:
                reached = np.zeros(len(at), bool)
                reached[hub := left.pop()] = True
                while (more := reached | whole[reached].any(0)).sum() > reached.sum():
                    reached = more
                group = np.flatnonzero(reached).tolist()
                out += [(keys[at[i]], None, keys[at[hub]]) for i in group if i != hub]
                left.difference_update(group)
        return pa.table({"key": pa.array([x[0] for x in out], pa.binary()), "links": pa.array([x[1] for x in out], pa.int64()), "other": pa.array([x[2] for x in out], pa.binary())})

    return units.groupBy("bin", "low", "high").applyInArrow(verify, "key binary, links long, other binary")


def _units(docs: DataFrame, nodes: DataFrame, groups: DataFrame, size: int, threshold: float) -> DataFrame:
    """Sets of the nodes in groups, once for each unit (bin, low, high) of two blocks that they belong to.

    A group of several blocks is dealt by classes of set size: linked sets are of one class or of neighbouring ones.
    """
    step = -math.log(threshold) * (1 + 1e-9)
    of = nodes.select(F.col("key").alias("node"), "rep", "copies", F.floor(F.log("n") / step).cast("long").alias("sizes"))
    placed = groups.join(of, "node")
    whole = placed.groupBy("root", "sizes").agg(F.count(F.lit(1)).alias("n"))
    by_root = Window.partitionBy("root")
    whole = whole.withColumn("small", F.sum("n").over(by_root) <= BLOCK)
    whole = whole.withColumn("blocks", F.when(F.col("small"), 1).otherwise(F.ceil(F.col("n") / BLOCK)))
    up, down = (f("blocks").over(by_root.orderBy("sizes")) for f in (F.lead, F.lag))
    up_at, down_at = (f("sizes").over(by_root.orderBy("sizes")) for f in (F.lead, F.lag))
    beside = lambda n, at, by: F.when(~F.col("small") & (at == F.col("sizes") + by), n).otherwise(0)
    whole = whole.withColumn("up", beside(up, up_at, 1)).withColumn("down", beside(down, down_at, -1)).drop("n")
    bins = max(1, groups.count() // BLOCK)
    placed = (
        placed.join(whole, ["root", "sizes"])
        .withColumn("sizes", F.when(F.col("small"), 0).otherwise(F.col("sizes")))
        .withColumn("block", F.col("sizes") * SUB + F.pmod(F.xxhash64("node"), F.col("blocks")))
        .withColumn("bin", F.when(F.col("small"), F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.xxhash64("root")))
    )
    blocks = lambda n, by: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), lambda k: (F.col("sizes") + by) * SUB + k)).otherwise(F.array().cast("array<long>"))
    placed = placed.withColumn("with", F.concat(blocks("blocks", 0), blocks("up", 1), blocks("down", -1)))
    placed = placed.select(F.col("rep.doc_id").alias("rep_id"), F.col("rep.mark").alias("rep_mark"), "node", "root", "bin", "with", "block", "copies")
    rows_of = _marked(docs).join(placed, F.col("doc_id").eqNullSafe(F.col("rep_id")) & F.col("mark").eqNullSafe(F.col("rep_mark")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for batch in pieces(batches, release=True):
            grams = [shingles(words_of(t), size, hasher) for t in column(batch, "text")]
            keep = []
            for g, k in zip(grams, column(batch, "node"), strict=True):  # rows that repeat a document count once
                keep.append(k not in seen and set_key(g) == k)
                seen.add(k)
            keep = pa.array(keep, pa.bool_())
            names = ["root", "bin", "with", "block", "copies"]
            cols = [batch.column("node"), pa.array([g.tobytes() for g in grams], pa.binary()), *(batch.column(c) for c in names)]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in cols], ["key", "grams", *names])

    sets = rows_of.select("text", "node", "root", "bin", "with", "block", "copies").mapInArrow(
        cut, "key binary, grams binary, root binary, bin long, with array<long>, block long, copies long"
    )
    units = sets.withColumn("with", F.explode("with"))
    return units.withColumn("low", F.least("block", "with")).withColumn("high", F.greatest("block", "with")).drop("with")


def _classes(docs: DataFrame, size: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, mark, key), (keys: key, first: the row that names its class, copies, n_links)."""
    bands, rows = banding(threshold, recall)
    signed = written(_signatures(docs, size, bands, rows), "near-signatures")
    nodes = signed.where("key is not null").groupBy("key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("rep"),
        F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("signature").alias("signature"), F.first("n").alias("n"),
    )
    nodes = written(nodes, "near-nodes", rows=signed.count())
    n_nodes = nodes.count()
    groups = written(components(_candidates(nodes, threshold, n_nodes * bands), "near-candidates"), "near-groups")
    found = written(_verify(_units(docs, nodes, groups, size, threshold), threshold), "near-links")
    links = found.where("other is null").groupBy("key").agg(F.sum("links").alias("links"))
    classes = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")), "near-classes")
    named = nodes.select("key", "rep").join(classes.withColumnRenamed("node", "key"), "key")
    names = named.groupBy("root").agg(F.min("rep").alias("first"))
    about = (
        nodes.select("key", "rep", "copies")
        .join(links, "key", "left")
        .join(named.select("key", "root").join(names, "root").select("key", "first"), "key", "left")
        .select("key", F.coalesce("first", "rep").alias("first"), "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    )
    return signed.select("doc_id", "mark", "key"), written(about, "near-about", rows=n_nodes)


def jaccard_join(docs: DataFrame, size: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of its class), n_links (other rows whose
    similarity reaches the threshold).

    Keys that many rows share are joined by a broadcast, of at most ``HEAVY`` keys whatever the input; the others by
    a shuffle, in which no key has more than one in ``HEAVY`` of all rows (or 64).
    """
    with scratch(docs.sparkSession):
        rows, about = _classes(docs, size, threshold, recall)
        about = about.select("key", F.col("first.doc_id").alias("class_id"), "copies", "n_links")
        n = rows.count()
        bound = max(64, n // HEAVY)
        heavy = about.where(F.col("copies") > bound)
        # its size is bounded: copies add up to the rows, so at most HEAVY keys are above the bound
        shared = rows.join(F.broadcast(heavy), "key")
        rest = rows.join(F.broadcast(heavy.select("key")), "key", "left_anti").where("key is not null").join(about, "key")
        alone = rows.where("key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
        out = shared.select("doc_id", "class_id", "n_links").union(rest.select("doc_id", "class_id", "n_links")).union(alone)
        return written(out, "near-classes", stays=True, rows=n)


def one_of_each(docs: DataFrame, size: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row of each class, with all its columns: the one with the smallest doc_id (null only if all are), and
    of those the smallest hash of the text; of rows that repeat it, any one. Rows without words all stay."""
    id_, mark, n = (unused(c, docs) for c in ("kept_id", "kept_mark", "kept_n"))
    with scratch(docs.sparkSession):
        rows, about = _classes(docs, size, threshold, recall)
        first = about.select("first.doc_id", "first.mark").distinct()
        often = rows.where("key is not null").groupBy("doc_id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").toDF("i", "m", "n")
        named = first.join(often, F.col("doc_id").eqNullSafe(F.col("i")) & F.col("mark").eqNullSafe(F.col("m")), "left")
        named = named.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.coalesce("n", F.lit(1)).alias(n))
        n_rows = rows.count()
        named = written(named, "near-kept", stays=True, rows=n_rows)
    words = F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))
    same = docs["doc_id"].eqNullSafe(F.col(id_)) & (F.xxhash64(docs["text"]) == F.col(mark))
    kept = docs.where(~words).union(docs.where(words).join(named.where(F.col(n) == 1), same, "left_semi"))
    many = named.where(F.col(n) > 1)
    if not many.isEmpty():
        kept = kept.union(docs.where(words).join(many, same).dropDuplicates([id_, mark]).select(*[docs[c] for c in docs.columns]))
    return few_files(kept, n_rows, FILE_TEXTS)


#: The same join by all pairs that share an n-gram, in DuckDB's SQL.
JACCARD_SQL = r"""
WITH RECURSIVE dw AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
grams AS (
  SELECT DISTINCT r, hash(array_to_string(w[i:i + m - 1], ' ')) AS g
  FROM (SELECT r, w, least(5, len(w)) AS m, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM dw WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
common AS (SELECT a.r AS r1, b.r AS r2, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r GROUP BY 1, 2),
half AS (SELECT r1, r2 FROM common JOIN sizes a ON a.r = r1 JOIN sizes b ON b.r = r2 WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
links AS (SELECT r1, r2 FROM half UNION ALL SELECT r2, r1 FROM half),
reach AS (SELECT r, r AS other FROM dw UNION SELECT reach.r, r2 FROM reach JOIN links ON r1 = reach.other),
class AS (SELECT reach.r, min(dw.doc_id) AS class_id FROM reach JOIN dw ON dw.r = reach.other GROUP BY reach.r),
degree AS (SELECT r1 AS r, count(*) AS n FROM links GROUP BY 1)
SELECT doc_id, class_id, coalesce(n, 0)::BIGINT AS n_links FROM dw JOIN class USING (r) LEFT JOIN degree USING (r)
"""
