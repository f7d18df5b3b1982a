"""Token ids of all documents in binary files, with document boundaries as Elias-Fano sequences.

A file is a row of segments, each with a line feed after it (Spark's writer of raw lines puts it there). A segment,
all integers little-endian:

    8 bytes  magic "SLTOKEN2"           8 bytes  number of the segment     4 bytes  bytes of an id (2 or 4)
    8 bytes  bytes of the segment       8 bytes  documents                 8 bytes  ids
    8 bytes  documents without doc_id   8 bytes  doc_id of the first that has one
    Elias-Fano sequence of the ends of the documents, counted in ids
    Elias-Fano sequence of doc_id less the first doc_id
    the ids of all documents, one after the other

The number of a segment is its partition times 2**32, plus its place there. A file has ``IN_FILE`` segments at most, so that
files stay small however large a partition is (a segment ends with the document that fills it).

An Elias-Fano sequence of n rising values below u keeps floor(log2(u / n)) low bits of each value packed, and the
rest in unary as one bit vector: at most 2 + log2(u / n) bits a value. A 32-bit place of each 256th one bit leads
``select`` to any value without unpacking the rest; documents are read by it, a run of neighbours at a time.

    4 bytes n   1 byte low bits   8 bytes high bits (a multiple of 8)   places, low and high bits follow
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import chunks, shared
from strandline.llm import textbytes as tb

MAGIC, HEAD = b"SLTOKEN2", struct.Struct("<8sQIQQQQq")
SAMPLE = 256
#: Ids after which a segment ends, segments of a file, and bytes of texts that are encoded at once.
SEGMENT, IN_FILE, TOGETHER = 2 << 20, 16, 5 << 20
#: Letters (those of Latin scripts, which every Unicode version has) and one mark.
_MARKED = r"\A[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]+[" + chunks.MARKS + r"]\z"
_EF = struct.Struct("<IBQ")
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_loaded: dict[str, object] = {}


class EliasFano:
    """Random access to a rising sequence of unsigned integers, read in place."""

    def __init__(self, data: memoryview | bytes, at: int = 0):
        self.n, self.low, high = _EF.unpack_from(data, at)
        at += _EF.size
        k = -(-self.n // SAMPLE)
        self.places = np.frombuffer(data, "<u4", k, at)
        at += 4 * k
        low_bytes = -(-self.n * self.low // 8)
        self.lows = np.frombuffer(data, np.uint8, low_bytes, at)
        at += low_bytes
        self.highs = np.frombuffer(data, np.uint8, high // 8, at)
        self.end = at + high // 8

    @staticmethod
    def pack(values: np.ndarray) -> bytes:
        v = np.asarray(values, np.uint64)
        n = len(v)
        if not n:
            return _EF.pack(0, 0, 0)
        low = max(0, (int(v[-1]) // n).bit_length() - 1)
        places = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros(-(-(int(places[-1]) + 1) // 8) * 8, np.uint8)
        bits[places] = 1
        lows = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        return _EF.pack(n, low, len(bits)) + places[::SAMPLE].astype("<u4").tobytes() + np.packbits(lows, bitorder="little").tobytes() + np.packbits(bits, bitorder="little").tobytes()

    def _low(self, i: int) -> int:
        first, last = i * self.low, (i + 1) * self.low
        part = int.from_bytes(self.lows[first // 8 : -(-last // 8)].tobytes(), "little")
        return part >> first % 8 & (1 << self.low) - 1

    def select(self, i: int) -> int:
        """Value i, from the nearest sampled place on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.places[i // SAMPLE]), i % SAMPLE
        byte = place // 8
        bits = int(self.highs[byte]) & (0xFF << place % 8)
        while (ones := bits.bit_count()) <= left:
            left, byte = left - ones, byte + 1
            bits = int(self.highs[byte])
        for _ in range(left):
            bits &= bits - 1
        return byte * 8 + (bits & -bits).bit_length() - 1 - i << self.low | self._low(i)

    def run(self, i: int, j: int) -> np.ndarray:
        """Values i to j (not included): ``select`` of neighbours, which unpacks the high bits between two sampled places only."""
        if not 0 <= i <= j <= self.n:
            raise IndexError(i, j)
        if i == j:
            return np.empty(0, np.uint64)
        first, after = i // SAMPLE, -(-j // SAMPLE)
        begin = int(self.places[first])
        end = int(self.places[after]) if after < len(self.places) else len(self.highs) * 8
        bits = np.unpackbits(self.highs[begin // 8 : -(-end // 8)], bitorder="little")
        bits[: begin % 8] = 0
        ones = np.flatnonzero(bits)[i - first * SAMPLE : j - first * SAMPLE] + begin // 8 * 8
        highs = ones - np.arange(i, j)
        p, q = i * self.low, j * self.low
        lows = np.unpackbits(self.lows[p // 8 : -(-q // 8)], bitorder="little")[p % 8 : p % 8 + q - p].reshape(j - i, self.low).astype(np.uint64)
        return (highs.astype(np.uint64) << np.uint64(self.low)) | (lows << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class WordEncoder:
    """Whole texts with the tokenizers library; parts that occur several times in a call are encoded once.

    The library finds added tokens (such as ``<|endoftext|>``) in texts. With ``plain`` they are ordinary text instead.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        #: Texts with one of these are encoded whole: such a token also changes what stands beside it.
        self.added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        #: Only then do matches of the pattern never cross the cuts of chunks.split.
        self.cuts = str(self.tokenizer.pre_tokenizer).startswith("ByteLevel(add_prefix_space=False") and "use_regex=False" not in str(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None
        #: Bytes of each token: byte-level vocabularies write one character for one byte.
        self.sizes = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.sizes[i] = len(token)
        self.cuts = self.cuts and len(self._many(["\n"])[0]) == self.width
        self.marks = {m: int(np.frombuffer(x, f"<u{self.width}")[0]) for m, x in zip(chunks.MARKS, self._many(list(chunks.MARKS)), strict=True)}

    def _many(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, f"<u{self.width}").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _distinct(self, parts: pa.Array) -> chunks.Pool:
        """Ids of distinct parts: encoded as long texts, and cut where the bytes of the tokens add up to a part's.

        A mark after letters is a match of its own, so the letters are encoded alone, and once for all marks.
        """
        marked = pc.match_substring_regex(parts, _MARKED)
        stems = pc.if_else(marked, pc.utf8_slice_codeunits(parts, 0, -1), parts).dictionary_encode()
        stem = stems.dictionary
        bare = pc.or_(pc.starts_with(stem, "\n"), pc.equal(stem, ""))
        shown = pc.if_else(bare, stem, pc.binary_join_element_wise(" ", stem, ""))
        cuts = pa.array([*range(0, len(shown), 100), len(shown)], pa.int32())
        texts = pc.binary_join(pa.ListArray.from_arrays(cuts, shown), "").to_pylist()
        ids = np.concatenate([np.array(x.ids, f"<u{self.width}") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        stops = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(pc.binary_length(shown).to_numpy(), dtype=np.int64), "right")
        begins = np.concatenate(([0], stops[:-1]))
        index, mark = stems.indices.to_numpy(), marked.to_numpy(zero_copy_only=False)
        size = (stops - begins)[index]
        sizes = size + mark
        starts = np.cumsum(sizes) - sizes
        pool = np.empty(sizes.sum(), ids.dtype)
        pool[tb.places(starts, size)] = ids[tb.places(begins[index], size)]
        last = pc.utf8_slice_codeunits(parts.filter(marked), -1).dictionary_encode()
        pool[(starts + size)[mark]] = np.array([self.marks[m] for m in last.dictionary.to_pylist()], ids.dtype)[last.indices.to_numpy()]
        return pool, starts, sizes

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        return chunks.encode(texts, self._distinct, self._many, self.width, self.cuts, self.added)


def _encoder(path: str, plain: bool) -> WordEncoder:
    tb.kept["token_files"] = _loaded.clear
    if (path, plain) not in _loaded:
        _loaded[path, plain] = WordEncoder(path, plain)
    return _loaded[path, plain]


def pack_segment(number: int, width: int, doc_ids: list[int | None], ids: list[bytes]) -> bytes:
    """Documents in ascending doc_id order, those without one first."""
    none = sum(d is None for d in doc_ids)
    named = np.array(doc_ids[none:], np.int64)
    first = int(named[0]) if len(named) else 0
    ends = EliasFano.pack(np.cumsum([len(x) // width for x in ids]))
    names = EliasFano.pack((named - first).view(np.uint64))
    body = b"".join(ids)
    size = HEAD.size + len(ends) + len(names) + len(body)
    return HEAD.pack(MAGIC, number, width, size, len(ids), len(body) // width, none, first) + ends + names + body


class Segment:
    def __init__(self, data: memoryview, at: int = 0):
        magic, self.number, self.width, self.size, self.docs, self.n_ids, self.none, self.first = HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.ends = EliasFano(data, at + HEAD.size)
        self.names = EliasFano(data, self.ends.end)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, self.names.end)

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        """doc_id of documents i to j (not included)."""
        named = self.names.run(max(0, i - self.none), max(0, j - self.none))
        return [None] * (j - i - len(named)) + (named.view(np.int64) + self.first).tolist()

    def bounds(self, i: int, j: int) -> np.ndarray:
        """Start of document i and the ends of documents i to j (not included)."""
        return np.concatenate(([self.ends.select(i - 1) if i else 0], self.ends.run(i, j).astype(np.int64)))

    def document(self, i: int) -> np.ndarray:
        """Ids of document i, found by select alone."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def segments(data: bytes) -> Iterator[Segment]:
    at, view = 0, memoryview(data)
    while at < len(data):
        found = Segment(view, at)
        yield found
        at += found.size + 1


def _pack(tokenizer: str, end_id: int | None, plain: bool):
    @tb.task("token_files")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, e = TaskContext.get().partitionId() << 32, _encoder(tokenizer, plain)
        end = b"" if end_id is None else np.array([end_id], f"<u{e.width}").tobytes()
        names, held, size = [], [], 0
        for doc_ids, texts in _together(batches):
            new = [x.tobytes() + end for x in e.encode(texts)]
            del texts
            tb.give_back()
            names += doc_ids
            held += new
            size += sum(map(len, new))
            if size >= SEGMENT * e.width:
                yield pa.record_batch([pa.array([pack_segment(number, e.width, names, held)], pa.binary())], names=["segment"])
                names, held, size, number = [], [], 0, number + 1
        if held:
            yield pa.record_batch([pa.array([pack_segment(number, e.width, names, held)], pa.binary())], names=["segment"])

    return run


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.Array]]:
    """doc_ids and texts of about TOGETHER bytes, whatever the batches are."""
    doc_ids, texts, size = [], [], 0
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for i, j, data, _ in tb.chunks(batch, batch.schema.get_field_index("text"), TOGETHER):
            if size and size + len(data) > TOGETHER:
                yield doc_ids, pa.concat_arrays(texts)
                doc_ids, texts, size = [], [], 0
            doc_ids += ids[i:j]
            texts.append(batch.column("text").slice(i, j - i))
            size += len(data)
    if doc_ids:
        yield doc_ids, pa.concat_arrays(texts)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int | None = 2, plain: bool = False) -> None:
    """Encode each whole text and write files in ascending doc_id order: some files for each range of doc_id.

    Ids are those of the tokenizers library without special tokens added; where a text itself has the string of an added
    token, the library gives that token's id, or with ``plain`` those of ordinary text.

    A null text counts as empty and has the end id alone. Rows without doc_id come first; equal doc_ids are all
    written, ordered by text. Other columns are not looked at. An empty table gives no segment.
    """
    spark = docs.sparkSession
    shared.lean(spark)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ranged = rows.repartitionByRange(shared.partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    packed = ranged.mapInArrow(_pack(tokenizer, end_id, plain), "segment binary")
    packed.select(F.col("segment").cast("string").alias("value")).write.option("maxRecordsPerFile", IN_FILE).text(path)


@tb.task("token_files")
def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            found = [(x.number, x.n_ids) for x in segments(content.as_buffer())]
            if found:
                yield pa.record_batch([pa.array([found[0][0]], pa.int64()), pa.array([sum(x[1] for x in found)], pa.int64())], names=["number", "n_ids"])


def _documents(before, with_ids: bool):
    @tb.task("token_files")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                base = None
                for x in segments(content.as_buffer()):
                    base = before.value[x.number] if base is None else base
                    for i in range(0, x.docs, 4 * SAMPLE):
                        j = min(i + 4 * SAMPLE, x.docs)
                        at = x.bounds(i, j)
                        wide = x.ids[at[0] : at[-1]].astype("<u4")
                        places = (at - at[0]).tolist()
                        parts = [wide[p:q].tobytes() for p, q in zip(places[:-1], places[1:], strict=True)]
                        yield pa.record_batch(
                            [pa.array(x.doc_ids(i, j), pa.int64()), pa.array(at[:-1] + base), pa.array(np.diff(at)), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(parts if with_ids else [None] * len(parts), pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                        )
                    base += x.n_ids

    return run


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids (little-endian unsigned 32-bit) of each document.

    Starts and ends come from ``select``. Two numbers for each file reach the driver, as when Spark numbers rows over
    partitions. Documents written without doc_id have a null there; a folder without segments gives an empty table.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    before, total = {}, 0
    for number, n in files.mapInArrow(_heads, "number long, n_ids long").orderBy("number").collect():
        before[number], total = total, total + n
    out = files.mapInArrow(_documents(spark.sparkContext.broadcast(before), with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return out if with_ids else out.drop("ids")
