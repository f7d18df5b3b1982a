"""Web pages in WARC archives: bundles of records in seekable Zstandard files, equal payloads stored once.

A bundle is a file of independent Zstandard frames, each of some whole records, followed by two skippable frames:

    frame 0, frame 1, ...           records, the first of them a warcinfo
    skippable frame 0x184D2A50      Arrow: record_id, frame, offset in the uncompressed frame, length of the record
    skippable frame 0x184D2A5E      the seek table of the seekable format: compressed size, uncompressed size and xxhash of
                                    each frame; number of frames, descriptor, magic 0x8F92EAB1 at the end of the file

Readers without this module see a plain Zstandard file of WARC/1.1. A record is found through the index, its frame through
the seek table, and nothing but that frame is decompressed.

Record ids are ``<urn:page:PAGE_ID:DIGEST:K>``, where K counts rows that are equal in page id and payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import shared
from strandline.llm import textbytes as tb

#: Fixed values of the Zstandard seekable format.
SEEK_MAGIC, SEEK_FRAME, INDEX_FRAME = b"\xb1\xea\x92\x8f", 0x184D2A5E, 0x184D2A50
_SKIP, _ENTRY, _FOOT = struct.Struct("<II"), np.dtype([("stored", "<u4"), ("size", "<u4"), ("check", "<u4")]), struct.Struct("<IB4s")
_CHECKED = 0x80
#: Uncompressed bytes after which a frame ends, and stored bytes after which a bundle ends.
FRAME, BUNDLE, LEVEL = 1 << 18, 8 << 20, 3
#: Tasks that copies of one payload are dealt to.
SALTS = 256
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_INDEX = pa.schema([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])


class WarcError(ValueError):
    """What is read is no sound bundle or record."""


def record(kind: str, record_id: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{n}: {v}\r\n" for n, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of one whole record."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not blank or not lines[0].startswith("WARC/1."):
        raise WarcError("no WARC record")
    fields = {n.strip().lower(): v.strip() for n, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields.get("content-length", -1))
    if size < 0 or rest[size:] != b"\r\n\r\n":
        raise WarcError("length of a record")
    return fields, rest[:size]


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def page_record(page_id: int | None, url: str | None, digest: str, k: int, size: int, payload: bytes | None, first: int | None, date: str = DATE) -> tuple[str, bytes]:
    """Id and bytes of a page's record: a response with its payload, or without one a revisit of page ``first``."""
    name = "" if page_id is None else str(page_id)
    record_id = f"<urn:page:{name}:{digest}:{k}>"
    fields = [("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{'' if first is None else first}:{digest}:0>")]
    fields.append(("Content-Type", "application/http;msgtype=response"))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    return record_id, record("response" if payload is not None else "revisit", record_id, fields, block)


def page_of(record_id: str) -> int | None:
    name = record_id.split(":")[2]
    return int(name) if name else None


def page_facts(data: bytes) -> tuple[int | None, int, str, str, int | None] | None:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of a page's record; a response's payload is checked."""
    fields, block = parse(data)
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        return None
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.partition(b":")[2] for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise WarcError("payload does not match its digest")
    return page_of(fields["warc-record-id"]), size, digest, kind, page_of(fields["warc-refers-to"]) if kind == "revisit" else None


class BundleWriter:
    """Records of one bundle, as they come."""

    def __init__(self, name: str):
        self.stored, self.table, self.index, self.size = [], [], [], 0
        self.open, self.open_size = [], 0
        self.compressor = zstandard.ZstdCompressor(level=LEVEL)
        record_id = f"<urn:bundle:{name}>"
        self.add(record_id, record("warcinfo", record_id, [("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def add(self, record_id: str, data: bytes) -> None:
        self.index.append((record_id, len(self.table), self.open_size, len(data)))
        self.open.append(data)
        self.open_size += len(data)
        if self.open_size >= FRAME:
            self._cut()

    def _cut(self) -> None:
        plain = b"".join(self.open)
        self._put(self.compressor.compress(plain), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF)
        self.open, self.open_size = [], 0

    def _put(self, frame: bytes, size: int, check: int) -> None:
        self.stored.append(frame)
        self.table.append((len(frame), size, check))
        self.size += len(frame)

    def done(self) -> bytes:
        """The file, but for the magic number at its end."""
        if self.open:
            self._cut()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _INDEX, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*self.index, strict=True), _INDEX, strict=True)], schema=_INDEX))
        index = sink.getvalue().to_pybytes()
        self._put(_SKIP.pack(INDEX_FRAME, len(index)) + index, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        entries = np.array(self.table, _ENTRY).tobytes()
        foot = _FOOT.pack(len(self.table), _CHECKED, SEEK_MAGIC)
        return b"".join([*self.stored, _SKIP.pack(SEEK_FRAME, len(entries) + len(foot)), entries, foot])[: -len(SEEK_MAGIC)]


class Bundle:
    """A bundle read in place, from its end."""

    def __init__(self, content: memoryview | bytes):
        content = memoryview(content)
        if len(content) < _FOOT.size + _SKIP.size:
            raise WarcError("no seek table")
        n, checked, magic = _FOOT.unpack(content[-_FOOT.size :])
        start = len(content) - _FOOT.size - n * _ENTRY.itemsize
        if magic != SEEK_MAGIC or checked != _CHECKED or start < _SKIP.size or _SKIP.unpack(content[start - _SKIP.size : start])[0] != SEEK_FRAME:
            raise WarcError("no seek table")
        self.content, self.table = content, np.frombuffer(content, _ENTRY, n, start)
        self.at = np.concatenate(([0], np.cumsum(self.table["stored"], dtype=np.int64)))
        if self.at[-1] != start - _SKIP.size:
            raise WarcError("sizes in the seek table")
        magic, size = _SKIP.unpack(content[self.at[-2] : self.at[-2] + _SKIP.size])
        if magic != INDEX_FRAME:
            raise WarcError("no index")
        begin = int(self.at[-2]) + _SKIP.size
        self.index = pa.ipc.open_stream(pa.py_buffer(content[begin : begin + size])).read_all()

    def frame(self, k: int) -> bytes:
        plain = zstandard.ZstdDecompressor().decompress(self.content[self.at[k] : self.at[k + 1]], max_output_size=int(self.table["size"][k]))
        if len(plain) != self.table["size"][k] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table["check"][k]:
            raise WarcError("checksum of a frame")
        return plain

    def records(self, index: pa.Table | None = None) -> Iterator[tuple[str, bytes]]:
        """Ids and bytes of the records of an index (this bundle's own); each frame it names is decompressed once in a row."""
        at, plain = None, b""
        for x in (self.index if index is None else index).to_pylist():
            if x["frame"] != at:
                at, plain = x["frame"], self.frame(x["frame"])
            yield x["record_id"], plain[x["offset"] : x["offset"] + x["length"]]


def _pack(date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def closed() -> pa.RecordBatch:
            return pa.record_batch([pa.array([bundle.done()], pa.binary())], names=["bundle"])

        part, number, bundle, before, k = TaskContext.get().partitionId(), 0, None, None, 0
        for batch in batches:
            for *facts, payload in zip(*[batch.column(c) for c in ("page_id", "url", "digest", "n_bytes", "first", "shared", "payload")], strict=True):
                page_id, url, sha1, size, first, among = [x.as_py() for x in facts]
                k = k + 1 if before == (sha1, page_id) else 0
                before = (sha1, page_id)
                digest = base64.b32encode(sha1).decode()
                is_first = payload.is_valid and (k == 0 or not among)
                if bundle is None:
                    bundle, number = BundleWriter(f"{part}-{number}"), number + 1
                bundle.add(*page_record(page_id, url, digest, k, size, payload.as_py() if is_first else None, first, date))
                if bundle.size >= BUNDLE:
                    yield closed()
                    bundle = None
        if bundle is not None:
            yield closed()

    return tb.task("warc")(run)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0, date: str = DATE) -> None:
    """Write a record for each row into bundles below ``path``: the page's bytes in UTF-8 as the payload of a response.

    Of records whose payloads are equal and have ``least`` bytes or more, that of the smallest page id is the response and the
    others are revisits that refer to it; smaller payloads are all responses. Equality is that of SHA-1.

    A null html is an empty payload. Rows without page id come after all others: one is a response only where no row with that
    payload has an id. Of rows equal in page id and payload one is the response (that of the smallest url). A null url gives
    no target. Other columns are not looked at. An empty table gives no bundle. Copies of one payload are dealt to SALTS
    tasks, which learn of the smallest id by a join of ids; payloads of revisits are dropped there.
    """
    shared.lean(pages.sparkSession)
    body = F.encode(F.coalesce(F.col(f"`{html}`"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("n_bytes", F.octet_length("payload").cast("long"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
    known = shared.over_salts(rows.filter(F.col("n_bytes") >= least), "digest", "salt", F.min("page_id").alias("first"), F.min("first").alias("first"))
    out = rows.join(known.withColumn("shared", F.lit(True)), ["digest", "salt"], "left")
    response = F.col("shared").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    out = out.select("page_id", "url", "digest", "n_bytes", "first", "shared", F.when(response, F.col("payload")).alias("payload"))
    out = out.sortWithinPartitions("digest", F.asc_nulls_last("page_id"), "url").mapInArrow(_pack(date), "bundle binary")
    # a line of Spark's writer is a bundle, and what ends the line is the magic number at the bundle's end
    lines = out.select(F.col("bundle").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", SEEK_MAGIC.decode("latin-1"))
    lines.option("maxRecordsPerFile", 1).text(path)


def _bundles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content").filter("length(content) > 0")


def _mapped(of):
    """Rows of ``of`` (path, bundle, wanted entries or None) for each bundle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bundle = Bundle(batch.column("content")[i].as_buffer())
                yield from of(batch.column("path")[i].as_py(), bundle, batch.column("wanted")[i] if "wanted" in batch.schema.names else None)

    return tb.task("warc")(run)


def _entries(path: str, bundle: Bundle, _) -> Iterator[pa.RecordBatch]:
    for x in bundle.index.to_batches():
        yield pa.record_batch([pa.array([path] * x.num_rows), *x.columns], names=["bundle", *x.schema.names])


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    """record_id, its bundle, frame, offset in the uncompressed frame, and length: for each record below ``path``."""
    return _bundles(spark, path).mapInArrow(_mapped(_entries), "bundle string, record_id string, frame int, offset long, length long")


_FACTS = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def _facts(path: str, bundle: Bundle, _) -> Iterator[pa.RecordBatch]:
    rows = [x for _, data in bundle.records() if (x := page_facts(data))]
    yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_FACTS)], names=[n for n, _ in _FACTS])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each page's record below ``path``.

    Records are reached through index and seek table; frames, lengths, and payloads of responses are checked, and WarcError
    tells of what is unsound. A folder without bundles gives an empty table.
    """
    return _bundles(spark, path).mapInArrow(_mapped(_facts), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _wanted(path: str, bundle: Bundle, wanted: pa.ListScalar) -> Iterator[pa.RecordBatch]:
    found = pa.Table.from_pylist(sorted(wanted.as_py(), key=lambda x: (x["frame"], x["offset"])), _INDEX)
    ids, data = zip(*bundle.records(found), strict=True)
    yield pa.record_batch([pa.array(ids), pa.array([parse(x)[1] for x in data], pa.binary()), pa.array(data, pa.binary())], names=["record_id", "block", "record"])


def lookup(index: DataFrame, ids: DataFrame) -> DataFrame:
    """record_id, block and whole record of the records whose ids are in ``ids`` (record_id), through an ``archive_index``.

    Only bundles that hold one of them are read, and of these only the frames that the index names. Their names, one for each
    such bundle, reach the driver. Unknown ids and nulls give no row; an id asked for twice gives one.
    """
    spark = index.sparkSession
    found = shared.keep(index.join(ids.select("record_id").distinct(), "record_id", "left_semi"), "warc")
    names = [r[0] for r in found.select("bundle").distinct().collect()]
    if not names:
        return spark.createDataFrame([], "record_id string, block binary, record binary")
    entries = found.groupBy("bundle").agg(F.collect_list(F.struct(*_INDEX.names)).alias("wanted")).withColumnRenamed("bundle", "path")
    return _bundles(spark, names).join(entries, "path").mapInArrow(_mapped(_wanted), "record_id string, block binary, record binary")
