"""Katz backoff language model of any order, with Good-Turing discounts.

p(w | h) = d_r r / n(h) where the continuation h w was seen r > 0 times, else alpha(h) p(w | h'), with h' the context
without its first word; alpha(h) is what the seen continuations leave, divided by the mass that h' gives the words not
seen after h, so each row sums to 1. Unigrams are discounted likewise; what they leave belongs to one unknown word.
Counts above ``CUT`` are not discounted. Where Good-Turing would leave nothing, each count r of n becomes r / (n + 1).

The corpus becomes units of about ``UNIT`` tokens, each a file in the shared folder. There is a round for each order.
In the first, a unit sends its distinct words (as 128-bit hashes) with its own training counts to the shards of a table
partitioned by hash; a shard adds up all units' counts and sends each unit totals and numbers, in the order it asked.
In the next ones a unit sends the distinct continuations of its contexts, as the numbers of the former rounds, with
its own count and the corpus's count of the continuation of the shorter context; shards return totals, numbers, and
for each context how many continuations that the unit has not were seen r times, and how many of them r times after the
shorter context. With its own ones a unit has all that a context's discount, scale and mass depend on, in whole numbers,
so rows are normalised to the last digit. A context
that occurs in one unit only is never sent: the unit has its totals already. A context with more tokens than a fraction
of a shard is split by its next word over several shards, whose sums each unit adds up, so no frequent word, nor the
beginning of texts, gathers in one task. A last pass evaluates every token of a unit, from the shortest context up.

A continuation moves once a unit and way, however often it occurs. A unit sends at most one message a shard, and none
without contents. Shards are numbered by tokens (``SHARD`` each), at least one for each shuffle partition. Replies are
shuffled once: a unit keeps those of each round in a file beside its own, where later rounds read them. Tables that a
later step doesn't read are deleted, and Spark is told to delete the shuffle files of finished steps.

Tokens: lower-cased (A-Z) words between white space, then one end; an unseen context before the first word is a
context of its own. Documents whose fold of 10 is 0 are held out of training and scored alike. Null texts are empty:
one end token. A text of any length is read whole, into one unit. Repeated rows and null ids are documents of their
own; extra columns are ignored. An empty table gives no rows; with no training document every token is unknown and
scores log10 of 1.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import nullcontext
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from kinforge.llm.common import column, delete, forget_shuffles, open_fs, pieces, release_memory, scratch, shared_path, tokens_of, written
from kinforge.llm.langid import fold

UNIT, SHARD, CUT = 1_250_000, 4_000_000, 5
#: Numbers are shard and place in it; the context before a text's first word has the last place of the first shard.
PLACE_BITS = 40
PLACE = (1 << PLACE_BITS) - 1


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of integers as bytes in planes (all lowest bytes first), compressed."""
    raw = b"".join(
        np.array([len(a), width := a.itemsize * (a.shape[1] if a.ndim > 1 else 1)], "<u4").tobytes()
        + np.ascontiguousarray(a).view(np.uint8).reshape(len(a), width).T.tobytes()
        for a in arrays
    )
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, width = np.frombuffer(raw, "<u4", 2, at).tolist()
        planes = np.frombuffer(raw, np.uint8, n * width, at + 8).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").reshape(n) if width in (1, 2, 4, 8) else planes.T)
        at += 8 + n * width
    return out


def sparse(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A matrix of mostly zeros, column by column: bits of the other places, and what is there."""
    flat = x.T.ravel()
    some = flat != 0
    return np.packbits(some), flat[some].astype(np.uint64)


def dense(bits: np.ndarray, values: np.ndarray, rows: int, columns: int) -> np.ndarray:
    flat = np.zeros(rows * columns, np.int64)
    flat[np.unpackbits(bits, count=len(flat)).view(bool)] = values
    return flat.reshape(columns, rows).T


def rising(x: np.ndarray) -> np.ndarray:
    """Differences of numbers that don't fall, the first one whole."""
    return np.diff(x, prepend=0).astype(np.uint64)


def risen(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x.astype(np.int64))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, a place of each, and each key's place among them; ties need no order."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return sorted_[new], order[new], place


def ranks(x: np.ndarray) -> np.ndarray:
    """Places in order of distinct numbers."""
    out = np.empty(len(x), np.int64)
    out[np.argsort(x)] = np.arange(len(x))
    return out


def joint(high: np.ndarray, low: np.ndarray, n_low: int) -> np.ndarray:
    """One number for each pair, in their order."""
    if len(high) and (int(high.max()) + 1) * n_low >= 1 << 63:
        raise OverflowError("more pairs than 64 bits number")
    return high * n_low + low


@dataclass
class Unit:
    """Documents as numbers of the unit's distinct words, by first appearance: ``ids`` of all tokens, ``lengths`` in
    tokens; ``order`` has the words by hash."""

    doc_ids: list
    held: np.ndarray
    lengths: np.ndarray
    order: np.ndarray
    ids: np.ndarray

    @property
    def n_words(self) -> int:
        return len(self.order)

    def save(self, url: str) -> None:
        fs, path = open_fs(url)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        numbers = np.array([d or 0 for d in self.doc_ids], np.int64).view(np.uint64)
        with fs.open_output_stream(path) as out:
            out.write(pack(known, numbers, self.held.astype(np.uint8), self.lengths.astype(np.uint32), self.order.astype(np.uint32), self.ids.astype(np.uint32)))

    @classmethod
    def load(cls, url: str) -> Unit:
        fs, path = open_fs(url)
        with fs.open_input_stream(path) as file:
            known, numbers, held, lengths, order, ids = unpack(file.read())
        doc_ids = [int(d) if k else None for d, k in zip(numbers.view(np.int64), known, strict=True)]
        return cls(doc_ids, held.astype(bool), lengths.astype(np.int64), order.astype(np.int64), ids.astype(np.int64))

    def trained(self) -> np.ndarray:
        return np.repeat(~self.held, self.lengths)

    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths


def make_units(docs: DataFrame, unit_tokens: int) -> DataFrame:
    """Table (path, words, tokens) of the units' files and of those with the hashes of their words, in order."""
    folder, beside = (shared_path(docs.sparkSession, f"lm-{x}") for x in ("units", "hashes"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        numbers: dict[bytes, int] = {b"": 0}  # no word is empty: this one is the end
        doc_ids, held, lengths, ids, n = [], [], [], [], 0

        def finish() -> pa.RecordBatch:
            keys = np.frombuffer(b"".join(map(xxh3_128_digest, numbers)), ">u8").reshape(-1, 2).astype(np.uint64)
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            name = uuid.uuid4().hex
            Unit(doc_ids, np.array(held, bool), np.array(lengths), order, np.concatenate(ids)).save(f"{folder}/{name}")
            fs, inner = open_fs(f"{beside}/{name}")
            fs.create_dir(inner.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(inner) as out:
                out.write(pack(keys[order, 0], keys[order, 1]))
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([f"{beside}/{name}"]), pa.array([n], pa.int64())], ["path", "words", "tokens"])

        for batch in pieces(batches):
            for doc_id, out, text in zip(*(column(batch, c) for c in ("doc_id", "held_out", "text")), strict=True):
                words = tokens_of(text)
                for w in words:
                    if w not in numbers:
                        numbers[w] = len(numbers)
                own = np.zeros(len(words) + 1, np.int64)
                own[:-1] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                doc_ids.append(doc_id)
                held.append(out)
                lengths.append(len(own))
                ids.append(own)
                n += len(own)
                if n >= unit_tokens:
                    yield finish()
                    numbers, doc_ids, held, lengths, ids, n = {b"": 0}, [], [], [], [], 0
        if doc_ids:
            yield finish()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "text")
    return written(rows.mapInArrow(write, "path string, words string, tokens long"), "lm-manifest")


def discounts(counts: np.ndarray) -> np.ndarray:
    """d_0 .. d_CUT by Katz from the numbers of types seen 1 .. CUT + 1 times; 1 where Good-Turing has none."""
    d = np.ones(CUT + 1)
    n = np.asarray(counts, float)
    if n[0] <= 0:
        return d
    a = (CUT + 1) * n[CUT] / n[0]
    for r in range(1, CUT + 1):
        if n[r - 1] > 0 and n[r] > 0 and a < 1:
            x = ((r + 1) * n[r] / (r * n[r - 1]) - a) / (1 - a)
            d[r] = x if 0 < x < 1 else 1.0
    return d


def discounted(r: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Counts after the discount."""
    return np.where(r <= CUT, d[np.minimum(r, CUT).astype(np.int64)], 1.0) * r


@dataclass
class Unigrams:
    """Discounted unigram model from global statistics [N, V, n_1 .. n_(CUT+1)]."""

    stats: np.ndarray

    def __post_init__(self):
        self.n, self.v = int(self.stats[0]), int(self.stats[1])
        self.d = discounts(self.stats[2:])
        low = np.arange(1, CUT + 1)
        taken = float(((1 - self.d[1:]) * low * self.stats[2 : 2 + CUT]).sum())
        self.scale = 1.0 / self.n if taken > 0 else 1.0 / (self.n + 1)
        self.unknown = taken / self.n if taken > 0 else 1.0 / (self.n + 1)
        if not self.n:
            self.unknown = 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d) * self.scale, self.unknown) if self.n else np.ones(len(c))


def backoff(n: np.ndarray, types: np.ndarray, seen_mass: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale of discounted counts, alpha) of contexts with n tokens, ``types`` (context x CUT) numbers of
    continuations seen 1 .. CUT times, and the mass that the shorter context gives the seen continuations."""
    taken = ((1 - d[1:]) * np.arange(1, CUT + 1) * types).sum(1)
    some = np.maximum(n, 1)
    scale = np.where(taken > 0, 1.0 / some, 1.0 / (some + 1))
    left = np.where(taken > 0, taken / some, 1.0 / (some + 1))
    return scale, np.where(n > 0, left / np.maximum(1 - seen_mass, 1e-12), 1.0)


def _count_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(c[(c > 0) & (c <= CUT + 1)], minlength=CUT + 2)[1:].tolist()


def about_contexts(ctx: np.ndarray, seen: np.ndarray, lower: np.ndarray, n: int) -> np.ndarray:
    """(context, 2 CUT + 1): continuations seen 1 .. CUT times; of the seen ones those whose shorter continuation was
    seen 1 .. CUT times, and the sum of the other ones' counts there."""
    some = seen > 0
    ctx, seen, lower = ctx[some], seen[some], lower[some]
    out = np.empty((n, 2 * CUT + 1), np.int64)
    for k, r in enumerate((seen, lower)):
        table = np.bincount(ctx * (CUT + 2) + np.minimum(r, CUT + 1), minlength=n * (CUT + 2)).reshape(n, CUT + 2)
        out[:, k * CUT : (k + 1) * CUT] = table[:, 1 : CUT + 1]
    big = lower > CUT
    out[:, -1] = np.bincount(ctx[big], lower[big], n)
    return out


class Level:
    """A unit's distinct continuations at one order, in order of context and word.

    ``before``: each token's context, as the place of the continuation that ends before it among those of the order
    below (one past the last: none); ``n``, ``number``: by such places, the corpus's tokens after a context, and its
    number. ``words``: numbers of the unit's words; ``lower``: for each token, the corpus's count of its continuation
    of the shorter context.
    """

    def __init__(self, unit: Unit, before: np.ndarray, n: np.ndarray, number: np.ndarray, words: np.ndarray, lower: np.ndarray, unigram: bool):
        keys, first, self.place = distinct(joint(before, unit.ids, unit.n_words))
        ctx, word = np.divmod(keys, unit.n_words)
        new = np.ones(len(ctx), bool)
        new[1:] = ctx[1:] != ctx[:-1]
        places, self.ctx = ctx[new], np.cumsum(new) - 1
        self.word, self.word_rank, self.n_words = words[word], ranks(words)[word], len(words)
        self.own = np.bincount(self.place[unit.trained()], minlength=len(keys))
        self.lower = lower[first]
        self.first = first
        self.n, self.number = n[places], number[places]
        self.by_word = unigram  # the shorter continuation is the word alone

    def deal(self, shards: int, split: int) -> None:
        """Which continuations go to which shard, and which contexts are asked for there."""
        away = np.bincount(self.ctx, self.own, len(self.n)).astype(np.int64) != self.n
        parts = np.clip(-(-self.n // split), 1, shards)
        at = np.flatnonzero(away[self.ctx])
        ctx = self.ctx[at]
        host = ((self.number[ctx] >> PLACE_BITS) + (self.word[at] & PLACE) % parts[ctx]) % shards
        rank = ranks(np.where(away, self.number, -1 - np.arange(len(away))))  # contexts that stay may have no number
        order = np.argsort(joint(joint(host, rank[ctx], len(rank)), self.word_rank[at], self.n_words))
        self.away, self.sent, self.host = away, at[order], host[order]
        wide = np.flatnonzero(away & (parts > 1))  # contexts that other units may have continued elsewhere
        more = np.repeat(wide, parts[wide])
        turn = np.arange(len(more)) - np.repeat(np.cumsum(parts[wide]) - parts[wide], parts[wide])
        ask_host = np.concatenate((self.host, ((self.number[more] >> PLACE_BITS) + turn) % shards))
        ask_ctx = np.concatenate((self.ctx[self.sent], more))
        runs = np.concatenate((np.ones(len(self.sent), np.int64), np.zeros(len(more), np.int64)))
        order = np.argsort(joint(ask_host, rank[ask_ctx], len(rank)))
        ask_host, ask_ctx, runs = ask_host[order], ask_ctx[order], runs[order]
        new = np.ones(len(order), bool)
        new[1:] = (ask_host[1:] != ask_host[:-1]) | (ask_ctx[1:] != ask_ctx[:-1])
        self.ask_host, self.ask_ctx = ask_host[new], ask_ctx[new]
        self.runs = np.bincount(np.cumsum(new) - 1, runs, new.sum()).astype(np.int64) if len(new) else runs

    def messages(self, shards: int) -> Iterator[tuple[int, bytes]]:
        hosts = np.unique(self.ask_host)
        asks, rows = (np.searchsorted(x, np.append(hosts, shards)) for x in (self.ask_host, self.host))
        for k, host in enumerate(hosts.tolist()):
            q, e = slice(asks[k], asks[k + 1]), self.sent[rows[k] : rows[k + 1]]
            names, first, at = distinct(self.word[e])
            # a word's number, and its count where that is the shorter continuation's, go once; then places among them
            lower = self.lower[e][first] if self.by_word else self.lower[e]
            steps = np.diff(at, prepend=0)
            begins = (np.cumsum(self.runs[q]) - self.runs[q])[self.runs[q] > 0]
            steps[begins] = at[begins]
            yield host, pack(rising(self.number[self.ask_ctx[q]]), self.runs[q].astype(np.uint32), rising(names), steps.astype(np.uint32), self.own[e].astype(np.uint32), lower.astype(np.uint64))

    def take(self, replies: list[bytes]) -> None:
        """Corpus counts ``seen``, numbers and ``about`` of the contexts, from the shards' replies in order."""
        self.seen, self.numbers = self.own.copy(), np.full(len(self.own), -1, np.int64)
        rows = None
        if replies:
            parts = [unpack(b) for b in replies]
            self.seen[self.sent] = np.concatenate([x[0] for x in parts])
            if any(len(x[1]) for x in parts):  # numbers come for what other units have seen too
                more = self.seen[self.sent] != self.own[self.sent]
                cuts = np.cumsum([len(x[0]) for x in parts])[:-1]
                hosts = [h[m] for h, m in zip(np.split(self.host, cuts), np.split(more, cuts), strict=True)]
                self.numbers[self.sent[more]] = np.concatenate([(h << PLACE_BITS) | risen(x[1]) for h, x in zip(hosts, parts, strict=True)])
            asks = np.unique(self.ask_host, return_counts=True)[1]
            rows = np.concatenate([dense(x[2], x[3], n, 2 * CUT + 1) for x, n in zip(parts, asks, strict=True)])
        self.about = about_contexts(self.ctx, self.seen, self.lower, len(self.n))
        if rows is not None:  # what other units alone have seen
            alone = np.bincount(self.ask_ctx, minlength=len(self.n))[self.ask_ctx] == 1
            self.about[self.ask_ctx[alone]] += rows[alone]
            np.add.at(self.about, self.ask_ctx[~alone], rows[~alone])

    def probabilities(self, d: np.ndarray, d_lower: np.ndarray, scale_lower: np.ndarray, p_lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the distinct continuations, and the contexts' scales; ``scale_lower`` and ``p_lower`` are by token."""
        low = d_lower[1:] * np.arange(1, CUT + 1)
        first = np.zeros(len(self.n), np.int64)
        first[self.ctx[::-1]] = self.first[::-1]  # a token of each context
        mass = (self.about[:, CUT : 2 * CUT] @ low + self.about[:, -1]) * scale_lower[first]
        scale, alpha = backoff(self.n.astype(float), self.about[:, :CUT].astype(float), mass, d)
        return np.where(self.seen > 0, discounted(self.seen, d) * scale[self.ctx], alpha[self.ctx] * p_lower[self.first]), scale


class State:
    """What a unit knows after the rounds whose replies it has: words' totals and numbers, then level by level."""

    def __init__(self, path: str, replies: list[list[tuple[int, bytes]]], shards: int, split: int, docs: int, last: bool = False):
        self.unit = Unit.load(path)
        parts = [(shard, unpack(b)) for shard, b in sorted(replies[0])]
        self.total, self.words = (np.empty(self.unit.n_words, np.int64) for _ in range(2))
        self.total[self.unit.order] = np.concatenate([x[0] for _, x in parts])
        self.words[self.unit.order] = np.concatenate([(shard << PLACE_BITS) | risen(x[1]) for shard, x in parts])
        self.levels: list[Level] = []
        unit = self.unit
        place, seen, numbers = unit.ids, self.total, self.words
        for k in range(1, len(replies) + (not last)):
            before = np.concatenate(([0], place[:-1]))
            before[unit.starts()] = len(seen)
            level = Level(unit, before, np.append(seen, docs), np.append(numbers, PLACE), self.words, seen[place], k == 1)
            level.deal(shards, split)
            self.levels.append(level)
            if k == len(replies):  # not asked yet: this level is what would be sent
                break
            level.take([b for _, b in sorted(replies[k])])
            place, seen, numbers = level.place, level.seen, level.numbers


def freeing(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same work; what is free after it goes back to the system."""

    def run(part: pa.Table) -> pa.Table:
        try:
            return work(part)
        finally:
            release_memory()

    return run


REPLY = "unit string, shard int, blob binary, stats array<long>"
_SCHEMA = pa.schema([("unit", pa.string()), ("shard", pa.int32()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64()))])
ASK = "unit string, shard int, blob binary"
_KEPT = pa.schema([("shard", pa.int32()), ("blob", pa.binary())])


def _replies(shard: int, units: list[str], blobs: list[bytes], stats: list[int]) -> pa.Table:
    n = len(units)
    return pa.table([units + [None], [shard] * (n + 1), blobs + [None], [None] * n + [stats]], schema=_SCHEMA)


def ask_words(units: DataFrame, shards: int) -> DataFrame:
    bounds = np.array([(s << 64) // shards for s in range(shards)], np.uint64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, words in zip(column(batch, "path"), column(batch, "words"), strict=True):
                unit = Unit.load(path)
                fs, inner = open_fs(words)
                with fs.open_input_stream(inner) as file:
                    high, low = unpack(file.read())
                counts = np.bincount(unit.ids[unit.trained()], minlength=unit.n_words).astype(np.uint32)[unit.order]
                cuts = np.append(np.searchsorted(high, bounds), len(high))
                some = [s for s in range(shards) if cuts[s] < cuts[s + 1]]
                blobs = [pack(*(x[cuts[s] : cuts[s + 1]] for x in (high, low, counts))) for s in some]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(some)), pa.array(some, pa.int32()), pa.array(blobs, pa.binary())], ["unit", "shard", "blob"])

    return units.select("path", "words").mapInArrow(ask, ASK)


def merge_words(asked: DataFrame) -> DataFrame:
    def merge(table: pa.Table) -> pa.Table:
        parts = [unpack(b) for b in table["blob"].to_pylist()]
        high, low, counts = (np.concatenate([x[i] for x in parts]) for i in range(3))
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        total = np.bincount(place, counts, int(new.sum())).astype(np.int64)
        cuts = np.cumsum([len(x[0]) for x in parts])[:-1]
        blobs = [pack(total[at].astype(np.uint64), rising(at)) for at in np.split(place, cuts)]
        stats = [int(total.sum()), int((total > 0).sum()), *_count_of_counts(total)]
        return _replies(table["shard"][0].as_py(), table["unit"].to_pylist(), blobs, stats)

    return asked.groupBy("shard").applyInArrow(freeing(merge), REPLY)


def _kept(url: str) -> list[tuple[int, bytes]]:
    fs, path = open_fs(url)
    with fs.open_input_stream(path) as file, pa.ipc.open_stream(file) as reader:
        table = reader.read_all()
    return list(zip(table["shard"].to_pylist(), table["blob"].to_pylist(), strict=True))


def _by_unit(table: DataFrame, units: DataFrame) -> GroupedData:
    """A round's replies by unit; one that had nothing to send, and so gets none, is there as well."""
    files = F.lit(None).cast("array<string>").alias("files")
    known = units.select("unit", F.lit(None).cast("int").alias("shard"), F.lit(None).cast("binary").alias("blob"), "files")
    return table.where("unit is not null").select("unit", "shard", "blob", files).union(known).groupBy("unit")


def _of_unit(table: pa.Table) -> tuple[str, list[str], list[tuple[int, bytes]]]:
    """Its path, the files of former rounds, and the replies of this one."""
    rows = zip(table["shard"].to_pylist(), table["blob"].to_pylist(), strict=True)
    files = next(x for x in table["files"].to_pylist() if x is not None)
    return table["unit"][0].as_py(), files, [(shard, blob) for shard, blob in rows if blob is not None]


def keep(table: DataFrame, units: DataFrame) -> DataFrame:
    """The units (unit, files), each with a round's replies in one more file."""

    def write(part: pa.Table) -> pa.Table:
        path, files, replies = _of_unit(part)
        url = f"{path}-{uuid.uuid4().hex}"
        fs, inner = open_fs(url)
        with fs.open_output_stream(inner) as out, pa.ipc.new_stream(out, _KEPT) as sink:
            sink.write_table(pa.table([[s for s, _ in replies], [b for _, b in replies]], schema=_KEPT))
        return pa.table({"unit": pa.array([path], pa.string()), "files": pa.array([[*files, url]], pa.list_(pa.string()))})

    return written(_by_unit(table, units).applyInArrow(write, "unit string, files array<string>"), "lm-kept", stays=True)


def ask_continuations(units: DataFrame, tasks: int, shards: int, split: int, docs: int) -> DataFrame:
    """What each unit sends for the order after those that it has replies of."""

    def sent(path: str, files: list[str]) -> pa.RecordBatch:
        own = list(State(path, [_kept(f) for f in files], shards, split, docs).levels[-1].messages(shards))
        return pa.RecordBatch.from_arrays([pa.array([path] * len(own), pa.string()), pa.array([s for s, _ in own], pa.int32()), pa.array([b for _, b in own], pa.binary())], ["unit", "shard", "blob"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in map(sent, column(batch, "unit"), column(batch, "files")):
                release_memory()
                yield own

    return units.repartition(tasks).mapInArrow(ask, ASK)


def merge_continuations(asked: DataFrame, round_: int, last: bool) -> DataFrame:
    """The replies of a round; a longer context that is one unit's own is never sent, and after the last round none is, so
    numbers go back for the other continuations only."""

    def merge(table: pa.Table) -> pa.Table:
        asks, contexts, words, counts, lowers = [], [], [], [], []
        for blob in table["blob"].to_pylist():
            number, runs, word, steps, count, lower = unpack(blob)
            asks.append(risen(number))
            runs = runs.astype(np.int64)
            contexts.append(np.repeat(asks[-1], runs))
            at = np.cumsum(steps.astype(np.int64))
            begins = (np.cumsum(runs) - runs)[runs > 0]
            at -= np.repeat(np.append(0, at)[begins], runs[runs > 0])
            words.append(risen(word)[at])
            counts.append(count)
            lowers.append((lower[at] if round_ == 2 else lower).astype(np.int64))
        sizes = [len(w) for w in words]
        names = np.unique(np.concatenate(asks))
        ctx, word = np.searchsorted(names, np.concatenate(contexts)), np.concatenate(words)
        del contexts, words
        wide = int((word & PLACE).max(initial=0)) + 1
        _, first, place = distinct(joint(ctx, joint(word >> PLACE_BITS, word & PLACE, wide), (int((word >> PLACE_BITS).max(initial=0)) + 1) * wide))
        del word
        seen = np.bincount(place, np.concatenate(counts), len(first)).astype(np.int64)
        about = about_contexts(ctx[first], seen, np.concatenate(lowers)[first], len(names))
        blobs, begin = [], 0
        for ask, size in zip(asks, sizes, strict=True):
            at, own = place[begin : begin + size], counts.pop(0)
            numbers = at[:0] if last else at[seen[at] != own]
            asked = np.searchsorted(names, ask)
            rest = about[asked] - about_contexts(np.searchsorted(asked, ctx[begin : begin + size]), seen[at], lowers.pop(0), len(ask))
            blobs.append(pack(seen[at].astype(np.uint32), rising(numbers), *sparse(rest)))
            begin += size
        return _replies(table["shard"][0].as_py(), table["unit"].to_pylist(), blobs, _count_of_counts(seen))

    return asked.groupBy("shard").applyInArrow(freeing(merge), REPLY)


def _summed(replies: DataFrame, width: int) -> np.ndarray:
    sums = replies.where("unit is null").agg(*[F.sum(F.col("stats")[i]) for i in range(width)]).first()
    return np.array([x or 0 for x in sums], np.int64)


def evaluate(state: State, stats: np.ndarray, more: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Sums over each document's tokens: n_known, base and model log10 probabilities."""
    unit, base = state.unit, Unigrams(stats)
    total = state.total
    p, scale, d = base.p(total)[unit.ids], np.full(len(unit.ids), base.scale), base.d
    for level, counts in zip(state.levels, more, strict=False):
        own = discounts(counts)
        values, scales = level.probabilities(own, d, scale, p)
        p, scale, d = values[level.place], scales[level.ctx][level.place], own
    plain = np.log10((total + 0.1) / (base.n + 0.1 * (base.v + 1)))
    doc = np.repeat(np.arange(len(unit.lengths)), unit.lengths)
    sums = lambda x: np.bincount(doc, x, len(unit.lengths))
    return {"n_known": sums(total[unit.ids] > 0).astype(np.int64), "base_score": sums(plain[unit.ids]), "score": sums(np.log10(p))}


def score(docs: DataFrame, shards: int | None = None, order: int = 3, unit_tokens: int = UNIT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score by contexts of up to ``order`` - 1 words."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    spark = docs.sparkSession
    with scratch(spark):
        units = make_units(docs, unit_tokens)
        tokens, n_units = units.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
        shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // SHARD))
        split = max(1, tokens // shards // 4)
        trained = docs.where(fold(F.col("doc_id"), 10) != 0).count()
        first = units.first()
        known = units.select(F.col("path").alias("unit"), F.array().cast("array<string>").alias("files"))
        counts = []
        for k in range(1, order + 1):
            with scratch(spark) if k < order else nullcontext():
                if k == 1:
                    table = merge_words(ask_words(units, shards))
                else:
                    table = merge_continuations(ask_continuations(known, max(1, n_units), shards, split, trained), k, k == order)
                table = written(table, f"lm-order-{k}")
                if first and k == 1:
                    delete(spark, first["words"].rpartition("/")[0])
                forget_shuffles(spark)
                counts.append(_summed(table, CUT + 3 if k == 1 else CUT + 1))
                if k < order:
                    known = keep(table, known)
                    forget_shuffles(spark)
        stats, *more = counts

        def finish(table: pa.Table) -> pa.Table:
            path, files, replies = _of_unit(table)
            state = State(path, [*map(_kept, files), replies], shards, split, trained, last=True)
            unit, sums = state.unit, evaluate(state, stats, more)
            n = len(unit.doc_ids)
            return pa.table({"doc_id": pa.array(unit.doc_ids, pa.int64()), "held_out": unit.held, "n_tokens": unit.lengths, "n_known": sums["n_known"], "train_tokens": np.full(n, stats[0]), "base_score": sums["base_score"], "score": sums["score"]})

        out = _by_unit(table, known).applyInArrow(freeing(finish), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        out = written(out, "lm-scores", stays=True)
        if first:
            delete(spark, first["path"].rpartition("/")[0])
    return out
