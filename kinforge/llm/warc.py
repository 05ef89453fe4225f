"""WARC records in ZIP packages: writer, and a reader that never unpacks.

Each task packs its pages into ZIP files of about ``package_bytes``, with stored members: ``archive/data.warc.gz`` (one
gzip member a record), ``indexes/index.cdxj`` (sorted lines of key, time and JSON, with offset and length) and
``datapackage.json`` (names, sizes and SHA-256 of the others). The reader finds the end record and, where counts or
offsets exceed the old limits, the ZIP64 one; walks the central directory; resolves the data offset of stored members
through their local headers; and then range-reads records by the index lines of any stored ``.cdx``, ``.cdxj`` or
``.cdx.gz`` index, so it reads packages of other writers too. An index is cut at bytes, a task reads the lines that
begin in its cut, and neighbouring records come in one read.

Of the records with equal payloads of at least ``min_revisit`` bytes the one with the smallest page_id is a
response, the others are revisits that refer to it and carry no payload; smaller payloads are always responses.

A null html is an empty payload. A null page_id is written as such: it is a revisit if an equal payload has an
id, else a response. Rows that repeat a page with its payload all have the smallest page_id, so all are responses: a
revisit refers to another page. Payloads of any length are written and read whole. An empty table gives no file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinforge.llm.common import column, open_fs, pieces, shared_path, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2000-01-01T00:00:00Z"


class ZipWriter:
    """Stored members, streamed, with ZIP64 records throughout."""

    def __init__(self, out):
        self.out, self.at, self.members, self.open = out, 0, [], None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.open = [raw, self.at, 0, 0]
        # sizes and checksum follow the data in a descriptor (flag 8)
        self._put(struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 8, 0, 0, 0x21, 0, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 20))
        self._put(raw + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        self.open[2] += len(data)
        self.open[3] = zlib.crc32(data, self.open[3])
        self._put(data)

    def end(self) -> None:
        self._put(struct.pack("<4sIQQ", b"PK\x07\x08", self.open[3], self.open[2], self.open[2]))
        self.members.append(self.open)

    def close(self) -> None:
        start = self.at
        for raw, at, size, crc in self.members:
            self._put(struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 8, 0, 0, 0x21, crc, 0xFFFFFFFF, 0xFFFFFFFF, len(raw), 28, 0, 0, 0, 0, 0xFFFFFFFF))
            self._put(raw + struct.pack("<HHQQQ", 1, 24, size, size, at))
        size, end64, n = self.at - start, self.at, len(self.members)
        self._put(struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, size, start))
        self._put(struct.pack("<4sIQI", b"PK\x06\x07", 0, end64, 1))
        self._put(struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0))


class ZipReader:
    """Directory of a ZIP file and ranges of its stored members; ``file`` needs size(), seek() and read()."""

    def __init__(self, file):
        self.file, self.members = file, {}
        size = file.size()
        tail_at = max(0, size - 65557)
        tail = self._read(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] > len(tail)):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of a central directory")
        n, length, start = struct.unpack_from("<HII", tail, at + 10)
        if n == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF:
            locator = self._read(tail_at + at - 20, 20)
            if locator[:4] != b"PK\x06\x07":
                raise ValueError("no ZIP64 locator")
            end64 = self._read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end record")
            n, length, start = struct.unpack_from("<QQQ", end64, 32)
        directory, at = self._read(start, length), 0
        for _ in range(n):
            if directory[at : at + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", directory, at + 8)
            crc, packed, full, n_name, n_extra, n_note = struct.unpack_from("<IIIHHH", directory, at + 16)
            header = struct.unpack_from("<I", directory, at + 42)[0]
            name = directory[at + 46 : at + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
            extra = directory[at + 46 + n_name : at + 46 + n_name + n_extra]
            while len(extra) >= 4:
                kind, width = struct.unpack_from("<HH", extra)
                if kind == 1:
                    values = iter(struct.unpack_from(f"<{width // 8}Q", extra, 4))
                    full = next(values) if full == 0xFFFFFFFF else full
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    header = next(values) if header == 0xFFFFFFFF else header
                extra = extra[4 + width :]
            self.members[name] = (method, header, packed, full, crc)
            at += 46 + n_name + n_extra + n_note

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def range_of(self, name: str) -> tuple[int, int]:
        """Absolute offset and length of a stored member's data."""
        method, header, packed, _, _ = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed")
        local = self._read(header, 30)
        if local[:4] != b"PK\x03\x04":
            raise ValueError(f"{name}: no local header")
        n_name, n_extra = struct.unpack_from("<HH", local, 26)
        return header + 30 + n_name + n_extra, packed

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        start, size = self.range_of(name)
        return self._read(start + at, size - at if n is None else min(n, size - at))


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def urn_page(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if re.fullmatch(r"-?[0-9]+", tail) else None


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, which tells the length of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {page_urn(page_id)}",
        "WARC-Target-URI: " + "".join((url or "").split()),
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {page_urn(refers_to)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields (names in lower case) and payload of one record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda raw: {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def sort_key(url: str | None) -> str:
    """Host labels in reverse order, then port, path and query, in lower case: ``com,example)/a?b``."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(:[0-9]+)?([^#]*)", "".join((url or "").split()))
    host = m[1].lower().removeprefix("www.")
    return f"{','.join(reversed(host.split('.')))}{m[2] or ''}){(m[3] or '/').lower()}"


def first_of_equals(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """The pages with ``first``: the smallest page_id among equal payloads, where others share them; else null.

    Digests that several pages share are written first: from that table's size Spark decides whether it is broadcast,
    so that no payload moves, or joined by a shuffle, whose large partitions (a common payload) it splits.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.unhex(F.sha2(F.col("html"), 256)).alias("digest")
    firsts = (
        own.where(F.octet_length("html") >= min_revisit)
        .select("page_id", digest)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "first")
    )
    return own.select("*", digest).join(written(firsts, "warc-firsts"), "digest", "left")


class Package:
    """Writes one package: records as they come, then index and description."""

    def __init__(self, url: str):
        fs, path = open_fs(url)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        self.url, self.stream, self.at, self.lines, self.sha = url, fs.open_output_stream(path), 0, [], hashlib.sha256()
        self.zip = ZipWriter(self.stream)
        self.zip.begin(DATA)

    def add(self, raw: bytes, about: dict, level: int) -> None:
        gz = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = gz.compress(raw) + gz.flush()
        self.zip.write(member)
        self.sha.update(member)
        where = {"length": str(len(member)), "offset": str(self.at), "filename": DATA.rpartition("/")[2]}
        self.lines.append((sort_key(about["url"]), self.at, json.dumps(about | where, ensure_ascii=False)))
        self.at += len(member)

    def close(self) -> None:
        self.zip.end()
        stamp = re.sub(r"\D", "", DATE)
        index = "".join(f"{key} {stamp} {text}\n" for key, _, text in sorted(self.lines)).encode()
        parts = [(DATA, self.at, self.sha), (INDEX, len(index), hashlib.sha256(index))]
        resources = [{"name": name.rpartition("/")[2], "path": name, "hash": f"sha256:{sha.hexdigest()}", "bytes": n} for name, n, sha in parts]
        for name, data in ((INDEX, index), ("datapackage.json", json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": resources}).encode())):
            self.zip.begin(name)
            self.zip.write(data)
            self.zip.end()
        self.zip.close()
        self.stream.close()


def write_archives(pages: DataFrame, min_revisit: int = 0, level: int = 2, package_bytes: int = 64 << 20) -> DataFrame:
    """Writes packages into the shared folder; returns the manifest (path, records) as a table."""
    folder = shared_path(pages.sparkSession, "warc")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package = None

        def finish() -> pa.RecordBatch:
            package.close()
            return pa.RecordBatch.from_arrays([pa.array([package.url]), pa.array([len(package.lines)], pa.int64())], ["path", "records"])

        for batch in pieces(batches, 256):
            for page_id, url, html, first in zip(*(column(batch, c) for c in ("page_id", "url", "html", "first")), strict=True):
                package = package or Package(f"{folder}/{uuid.uuid4().hex}.wacz")
                revisit = first is not None and first != page_id
                payload = html.encode("utf-8", "replace")
                about = {"url": "".join((url or "").split()), "mime": "warc/revisit" if revisit else "text/html", "status": "200", "digest": f"sha1:{base32_sha1(payload)}"}
                package.add(record(page_id, url, payload, revisit, first), about, level)
                if package.at >= package_bytes:
                    yield finish()
                    package = None
        if package:
            yield finish()

    rows = first_of_equals(pages, min_revisit).select(F.col("page_id").cast("long").alias("page_id"), "url", "html", "first")
    rows.mapInArrow(pack, "path string, records long").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema("path string, records long").parquet(f"{folder}/manifest")


class Cut:
    """Bytes ``begin`` to before ``end`` of a stored member as a file to read on from; a packed index as a whole."""

    def __init__(self, package: ZipReader, name: str):
        self.package, self.name = package, name
        self.start, self.size = package.range_of(name)
        self.whole = gzip.decompress(package.read(name)) if name.endswith(".gz") else None

    def lines(self, begin: int, end: int, step: int = 1 << 20) -> Iterator[bytes]:
        """The lines that begin in the cut, as lines of a split text file."""
        if self.whole is not None:
            yield from self.whole.splitlines() if not begin else ()
            return
        at = max(0, begin - 1)  # the byte before tells whether a line begins here
        rest = b"" if begin else b"\n"
        line_at = at - len(rest)
        while at < self.size:
            data = self.package.read(self.name, at, step)
            at += len(data)
            rest += data
            while (cut := rest.find(b"\n")) >= 0:
                if line_at >= begin:
                    yield rest[:cut]
                line_at, rest = line_at + cut + 1, rest[cut + 1 :]
                if line_at >= end:
                    return
                if line_at >= begin:
                    # all whole lines at once
                    *ready, rest = rest.split(b"\n")
                    for line in ready:
                        if line_at >= end:
                            return
                        yield line
                        line_at += len(line) + 1
        if rest and begin <= line_at < end:
            yield rest


def index_cuts(manifest: DataFrame, span: int = 4 << 20) -> DataFrame:
    """(path, name, begin, end): every index of the packages, cut at every ``span`` bytes; directories only are read."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in column(batch, "path"):
                fs, inner = open_fs(path)
                with fs.open_input_file(inner) as file:
                    for name, (_, _, size, _, _) in ZipReader(file).members.items():
                        if re.fullmatch(r"indexes/.*\.cdxj?(\.gz)?", name):
                            cuts = range(0, size, span) if not name.endswith(".gz") else [0]
                            rows += [(path, name, at, min(size, at + span)) for at in cuts]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "name", "begin", "end"])

    return manifest.select("path").mapInArrow(look, "path string, name string, begin long, end long")


def read_records(file, package: ZipReader, wanted: list[tuple[str, int, int]], gap: int = 64 << 10, most: int = 8 << 20) -> Iterator[bytes]:
    """Records (member, offset, length) as they stand in the package; neighbours with small gaps come in one read."""
    starts = {name: package.range_of(name)[0] for name in {x[0] for x in wanted}}
    wanted = sorted((starts[name] + at, n) for name, at, n in wanted)
    i = 0
    while i < len(wanted):
        begin, end, j = wanted[i][0], sum(wanted[i]), i + 1
        while j < len(wanted) and wanted[j][0] - end <= gap and sum(wanted[j]) - begin <= most:
            end, j = max(end, sum(wanted[j])), j + 1
        file.seek(begin)
        data = file.read(end - begin)
        for at, n in wanted[i:j]:
            yield data[at - begin : at - begin + n]
        i = j


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, span: int = 4 << 20) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record of the packages (path)."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        for batch in batches:
            for path, name, begin, end in zip(*(column(batch, c) for c in ("path", "name", "begin", "end")), strict=True):
                fs, inner = open_fs(path)
                with fs.open_input_file(inner) as file:
                    package, wanted, rows = ZipReader(file), [], []
                    for line in Cut(package, name).lines(begin, end):
                        where = json.loads(line[line.index(b"{") :])
                        wanted.append((f"archive/{where['filename']}", int(where["offset"]), int(where["length"])))
                    for raw in read_records(file, package, wanted):
                        warc, http, payload = parse(zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw)
                        digest, size = warc["warc-payload-digest"].removeprefix("sha1:"), int(http.get("content-length", len(payload)))
                        if warc["warc-type"] == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"{path}: damaged record {warc['warc-record-id']}")
                        rows.append((urn_page(warc["warc-record-id"]), warc["warc-target-uri"], size, digest, warc["warc-type"], urn_page(warc.get("warc-refers-to"))))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return index_cuts(manifest, span).repartition(n).mapInArrow(fetch, READ)


def warc_table(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Writes and reads back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read_archives(write_archives(pages, min_revisit)).drop("url")
