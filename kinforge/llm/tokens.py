"""Token ids in binary files with Elias-Fano document boundaries.

Documents are range-partitioned by id and sorted; each partition becomes one or more pairs of files: the ids of its
documents one after another (two bytes each where the vocabulary allows), streamed as they are encoded, and the ends
of the documents as an Elias-Fano sequence with its document ids. A pair ends at ``file_bytes`` of ids, so neither a
task's memory nor a file grows with the table. Files are written under names of their own and only named in the
manifest by the task attempt that succeeded, so lost executors leave at most unread files behind. Readers get every
boundary from the sequence's select structure.

Texts are encoded by the tokenizers library. Where single spaces separate words, the pre-tokeniser never joins
what stands on both sides, so the library encodes each distinct word with its leading space once and the ids are
remembered; texts with runs of white space go to the library whole. A text of any length is encoded whole.

Null or empty texts have the end id only. Null document ids come first; documents with one id (or none) stand in order
of a hash of their texts, and may span partitions. An empty table gives no file and no rows. Extra columns are ignored.

Boundary file: magic, then 64-bit little-endian counts (documents, ids, bytes an id, low bits, bytes of each section),
then the sections: validity of doc ids, doc ids (64-bit), low bits, high bits, select samples (32-bit).
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator
from contextlib import suppress
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinforge.llm.common import column, open_fs, pieces, shared_path

MAGIC = b"KFTOKEF2"
SAMPLE = 64
#: Letters that every version of the library takes for letters, and the ASCII punctuation but the apostrophe.
LETTERS, SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"
PLAIN, PIECE = re.compile(f"[{LETTERS}0-9\\n{SIGNS}]+"), re.compile(f"[{LETTERS}]+|[0-9]+|\\n|[{SIGNS}]+")


class EliasFano:
    """A nondecreasing sequence in about 2 + log2(universe / n) bits an element."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits = n, low_bits
        self.low, self.high, self.samples = low, np.frombuffer(high, np.uint8), samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8) if low_bits else np.empty((0, 0), np.uint8)
        ones = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, low_bits, np.packbits(low.ravel(), bitorder="little").tobytes(), np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        chunk = int.from_bytes(self.low[at // 8 : (at + self.low_bits + 7) // 8], "little")
        return (chunk >> (at % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample, whole bytes are skipped by their number of ones."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, value = at // 8, int(self.high[at // 8]) & (0xFF << (at % 8)) & 0xFF
        while (ones := value.bit_count()) <= left:
            left -= ones
            byte += 1
            value = int(self.high[byte])
        for _ in range(left):
            value &= value - 1
        one = byte * 8 + (value & -value).bit_length() - 1
        return ((one - i) << self.low_bits) | self._low(i)

    def select_run(self, begin: int, end: int) -> np.ndarray:
        """The values from the begin-th to before the end-th: only the bytes between the samples around them are read."""
        if not 0 <= begin <= end <= self.n:
            raise IndexError((begin, end))
        if begin == end:
            return np.empty(0, np.int64)
        first = begin // SAMPLE
        after = -(-end // SAMPLE)
        low_byte = int(self.samples[first]) // 8
        high_byte = int(self.samples[after]) // 8 + 1 if after < len(self.samples) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[low_byte:high_byte], bitorder="little")) + 8 * low_byte
        ones = ones[np.searchsorted(ones, int(self.samples[first])) + begin - first * SAMPLE :][: end - begin]
        out = (ones - np.arange(begin, end)) << self.low_bits
        if self.low_bits:
            at = begin * self.low_bits
            some = np.frombuffer(self.low, np.uint8)[at // 8 : (end * self.low_bits + 7) // 8]
            bits = np.unpackbits(some, bitorder="little")[at % 8 :][: (end - begin) * self.low_bits]
            out |= bits.reshape(-1, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits))
        return out.astype(np.int64)


class Encoder:
    """Ids of whole texts as 32-bit little-endian bytes, distinct words encoded once (up to ``limit`` kept).

    A text is cut at its spaces; a part may be encoded on its own (with the space before it) if it is not empty and
    neither begins nor ends with white space. New parts of plain letters, digits and signs are cut where the
    byte-level pre-tokeniser cuts (between those kinds) and go to the library's model piece by piece. Other parts
    are encoded many at a time, between tabs: a tab beside a part is a token of its own, so the ids between two tabs
    are the part's.
    """

    def __init__(self, path: str, limit: int = 800_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # found before all else
        settings = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        tab = self.tokenizer.encode("\t", add_special_tokens=False).ids
        model = type(self.tokenizer.model).__name__ == "BPE" and self.tokenizer.normalizer is None
        plain = settings.get("type") == "ByteLevel" and settings["use_regex"] and not settings["add_prefix_space"]
        self.byte_level = bool(plain and len(tab) == 1 and model)
        self.tab = tab[0] if tab else None
        printable = {*range(33, 127), *range(161, 173), *range(174, 256)}  # the others' characters begin at 256
        hidden = [b for b in range(256) if b not in printable]
        self.chars = {b: 256 + i for i, b in enumerate(hidden)}
        self.tokenize = self.tokenizer.model.tokenize
        self._forget()

    def _forget(self) -> None:
        # no ids for parts that are not encoded on their own
        self.spaced: dict[str, bytes | None] = {"": None}  # with a space before them
        self.bare: dict[str, bytes | None] = {"": None}  # first parts of texts

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, known: dict[str, bytes | None], before: str, piece: str) -> bytes:
        if (ids := known.get(piece)) is None:
            tokens = self.tokenize((before + piece).encode().decode("latin-1").translate(self.chars))
            ids = known[piece] = array("I", [t.id for t in tokens]).tobytes()
        return ids

    def _learn(self, known: dict[str, bytes | None], before: str, parts: Iterable[str]) -> None:
        others = []
        for part in set(filterfalse(known.__contains__, parts)):
            if part[0].isspace() or part[-1].isspace() or "\t" in part:
                known[part] = None
            elif PLAIN.fullmatch(part) and "\n\n" not in part:
                first, *rest = PIECE.findall(part)
                ids = self._piece(known, before, first)
                known[part] = ids + b"".join([self._piece(self.bare, "", p) for p in rest]) if rest else ids
            else:
                others.append(part)
        self._learn_rows(known, before, others)

    def _learn_rows(self, known: dict[str, bytes | None], before: str, new: list[str]) -> None:
        for at in range(0, len(new), 1024):
            some = new[at : at + 1024]
            row = self.tokenizer.encode(before + f"\t{before}".join(some), add_special_tokens=False).ids
            ids = np.asarray(row, "<u4")
            cuts = [*np.flatnonzero(ids == self.tab).tolist(), len(ids)]
            if len(cuts) != len(some):
                raise ValueError("the vocabulary joins tabs with words")
            whole, begin = ids.tobytes(), 0
            for part, cut in zip(some, cuts, strict=True):
                known[part] = whole[4 * begin : 4 * cut]
                begin = cut + 1

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.spaced) + len(self.bare) > self.limit:
            self._forget()
        out: list[bytes | None] = [None] * len(texts)
        split: dict[int, tuple[str, list[str]]] = {}
        for i, text in enumerate(texts):
            if not text:
                out[i] = b""
            elif self.byte_level and "  " not in text and not any(t in text for t in self.added):
                first, *rest = text.split(" ")
                split[i] = first, rest
        self._learn(self.bare, "", (first for first, _ in split.values()))
        self._learn(self.spaced, " ", chain.from_iterable(rest for _, rest in split.values()))
        spaced = self.spaced.__getitem__
        for i, (first, rest) in split.items():
            with suppress(TypeError):  # of a part without ids
                out[i] = b"".join([self.bare[first], *map(spaced, rest)])
        whole = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TokenWriter:
    """A pair of files: ``url`` + .ids takes ids as they come, ``url`` + .ends the boundaries at the end."""

    def __init__(self, url: str, id_bytes: int):
        self.url, self.id_bytes, self.n_ids = url, id_bytes, 0
        self.doc_ids, self.valid, self.sizes = array("q"), bytearray(), array("q")
        self.fs, path = open_fs(url)
        self.fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.path = path
        self.out = self.fs.open_output_stream(f"{path}.ids")

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.id_bytes}").tobytes())
        self.doc_ids.append(doc_id or 0)
        self.valid.append(doc_id is not None)
        self.sizes.append(len(ids))
        self.n_ids += len(ids)

    def close(self) -> None:
        self.out.close()
        ef = EliasFano.of(np.cumsum(np.frombuffer(self.sizes, np.int64)))
        sections = [
            np.packbits(np.frombuffer(self.valid, np.uint8), bitorder="little").tobytes(),
            np.frombuffer(self.doc_ids, np.int64).astype("<i8").tobytes(),
            ef.low,
            ef.high.tobytes(),
            ef.samples.tobytes(),
        ]
        head = np.array([len(self.sizes), self.n_ids, self.id_bytes, ef.low_bits, *map(len, sections)], "<i8").tobytes()
        with self.fs.open_output_stream(f"{self.path}.ends") as out:
            out.write(MAGIC + head + b"".join(sections))


class TokenFile:
    """Reader: document ids, boundaries and ranges of ids, without reading the rest."""

    def __init__(self, url: str):
        fs, path = open_fs(url)
        with fs.open_input_stream(f"{path}.ends") as file:
            whole = file.read()
        if whole[: len(MAGIC)] != MAGIC:
            raise ValueError(f"{url}: not a token file")
        at = len(MAGIC) + 72
        self.n, self.n_ids, self.id_bytes, low_bits, *sizes = np.frombuffer(whole[len(MAGIC) : at], "<i8").tolist()
        cuts = np.cumsum([at, *sizes])
        valid, ids, low, high, samples = (whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        self.valid = np.unpackbits(np.frombuffer(valid, np.uint8), bitorder="little", count=self.n).astype(bool)
        self.doc_ids = np.frombuffer(ids, "<i8")
        self.ends = EliasFano(self.n, low_bits, low, high, np.frombuffer(samples, "<u4"))
        self.file = fs.open_input_file(f"{path}.ids")

    def ids(self, begin: int, end: int) -> np.ndarray:
        self.file.seek(begin * self.id_bytes)
        return np.frombuffer(self.file.read((end - begin) * self.id_bytes), f"<u{self.id_bytes}")

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document: its bounds come from two selects."""
        return self.ids(self.ends.select(i - 1) if i else 0, self.ends.select(i))

    def documents(self, begin: int, end: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Bounds and ids of the documents from the begin-th to before the end-th, by one select of their run."""
        bounds = np.concatenate(([self.ends.select(begin - 1) if begin else 0], self.ends.select_run(begin, end)))
        ids = self.ids(int(bounds[0]), int(bounds[-1]))
        return bounds, [ids[a:b] for a, b in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0], strict=True)]


MANIFEST = "part long, place long, path string, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int = 2, files: int | None = None, file_bytes: int = 128 << 20) -> DataFrame:
    """Writes the files; returns the manifest (part, place, path, n_docs, n_ids), itself a table in the shared folder.

    ``files`` is the least number of partitions; more are made where Spark's estimate of the table asks for it.
    """
    spark = docs.sparkSession
    files = files or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = max(files, min(100_000, int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // (4 * file_bytes)))
    folder = shared_path(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(vocabulary)
        id_bytes = 2 if max(encode.tokenizer.get_vocab_size() - 1, end_id) < 1 << 16 else 4
        end = np.array([end_id], "<u4")
        part, place, writer = TaskContext.get().partitionId(), 0, None

        def finish() -> pa.RecordBatch:
            writer.close()
            cols = [[part], [place], [writer.url], [len(writer.sizes)], [writer.n_ids]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["part", "place", "path", "n_docs", "n_ids"])

        for batch in pieces(batches, 256):
            for doc_id, ids in zip(column(batch, "doc_id"), encode(column(batch, "text")), strict=True):
                writer = writer or TokenWriter(f"{folder}/{uuid.uuid4().hex}", id_bytes)
                writer.add(doc_id, np.concatenate((np.frombuffer(ids, "<u4"), end)))
                if writer.n_ids * id_bytes >= file_bytes:
                    yield finish()
                    place, writer = place + 1, None
        if writer:
            yield finish()

    # documents with one id are dealt by their texts, and those with one text too by where they came from
    by = ["doc_id", F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.select("doc_id", "text", by[1].alias("mark"), by[2].alias("row"))
    rows = rows.repartitionByRange(files, "doc_id", "mark", "row").sortWithinPartitions("doc_id", "mark", "row").select("doc_id", "text")
    rows.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_tokens(manifest: DataFrame, run: int = 1024) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files, in the order of the manifest's rows."""
    # one row for each file of file_bytes: the window's one task sees a row for some 100 MB of ids
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(column(batch, "path"), column(batch, "start"), strict=True):
                file = TokenFile(path)
                for at in range(0, file.n, run):
                    some = slice(at, min(at + run, file.n))
                    bounds, ids = file.documents(some.start, some.stop)
                    cols = [
                        pa.array(file.doc_ids[some], pa.int64(), mask=~file.valid[some]),
                        pa.array(bounds[:-1] + start, pa.int64()),
                        pa.array(np.diff(bounds), pa.int64()),
                        pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = files.select("path", "start").repartition(n)
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Writes and reads back: doc_id, start, n_tokens, ids_crc32."""
    return read_tokens(write_tokens(docs, vocabulary or default_vocabulary()))
