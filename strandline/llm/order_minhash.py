"""Order MinHash fingerprints: sensitive to the order of a text's k-mers, and so to its edit distance.

Each k-mer of a text (k bytes) gets its occurrence number, and (k-mer, number) is hashed. The hash deals it to one of
SLOTS bins and ranks it there: a permutation for each bin, over the elements that fall into it. Of each bin the TUPLE least
elements are taken, put back into text order, and hashed together; 16 bits of that are the slot of the
fingerprint. An empty bin takes the tuple of the next bin that is not empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import shared
from strandline.llm import textbytes as tb

K, SLOTS, TUPLE = 12, 64, 2
#: Bits for the text, the head of the k-mer's hash, that of its rank in a bin, and its place, when texts are sorted together.
#: Where heads are equal, whole 64-bit hashes decide.
_TEXT, _CODE, _RANK, _PLACE = 12, 30, 24, 22


def _sorted(text: np.ndarray, middle: np.ndarray, bits: int, place: np.ndarray) -> np.ndarray:
    """Order of elements by text, then by ``middle`` (``bits`` wide), then by place."""
    if len(place) < 1 << _PLACE and (not len(text) or text[-1] < 1 << (64 - bits - _PLACE)):
        key = (text.astype(np.uint64) << np.uint64(bits + _PLACE)) | (middle << np.uint64(_PLACE)) | np.arange(len(place), dtype=np.uint64)
        return (np.sort(key) & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    return np.lexsort((middle, text))  # a text too long for the packed key: the same order


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """SLOTS 16-bit values for each text. A text shorter than k bytes is one k-mer; an empty one has zeros."""
    lengths = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    out = np.zeros((len(texts), SLOTS), np.uint64)
    prefix = tb.sums(tb.byte_values(data))
    n = np.where(lengths >= K, lengths - K + 1, np.minimum(lengths, 1))
    text = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(text)) - np.repeat(np.concatenate(([0], np.cumsum(n)))[:-1], n)
    start = offsets[text] + place
    kmer = tb.mix(tb.spans(prefix, start, np.minimum(start + K, offsets[text + 1])))
    code = kmer >> np.uint64(64 - _CODE)
    order = _sorted(text, code, _CODE, place)
    first = np.ones(len(order), bool)
    by_text, by_kmer = text[order], kmer[order]
    first[1:] = (by_kmer[1:] != by_kmer[:-1]) | (by_text[1:] != by_text[:-1])
    mixed = np.flatnonzero(first[1:] & (code[order][1:] == code[order][:-1]) & (by_text[1:] == by_text[:-1])) + 1
    if len(mixed):  # different k-mers with one head: put them into the order of their whole hashes
        heads = np.flatnonzero(np.concatenate(([True], (code[order][1:] != code[order][:-1]) | (by_text[1:] != by_text[:-1]), [True])))
        for run in np.unique(np.searchsorted(heads, mixed, "right") - 1).tolist():
            part = order[heads[run] : heads[run + 1]]
            order[heads[run] : heads[run + 1]] = part[np.lexsort((part, kmer[part]))]
        by_kmer = kmer[order]
        first[1:] = (by_kmer[1:] != by_kmer[:-1]) | (by_text[1:] != by_text[:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    element = tb.mix(kmer ^ tb.mix(number.astype(np.uint64), 3), 4)
    slot = element & np.uint64(SLOTS - 1)
    middle = (slot << np.uint64(_RANK)) | (element >> np.uint64(64 - _RANK))
    order = _sorted(text, middle, _RANK + 6, place)
    group = text[order] * SLOTS + slot[order].astype(np.int64)
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.empty(0, np.int64)
    size = np.diff(np.append(begin, len(group)))
    more = np.flatnonzero(size > TUPLE)
    for g in more[middle[order[begin[more] + TUPLE - 1]] == middle[order[begin[more] + TUPLE]]].tolist():
        part = order[begin[g] : begin[g] + size[g]]  # heads are equal where the least elements end
        order[begin[g] : begin[g] + size[g]] = part[np.lexsort((part, element[part]))]
    picked = np.stack([np.where(size > k, order[np.minimum(begin + k, len(order) - 1)], np.iinfo(np.int64).max) for k in range(TUPLE)], axis=1) if len(begin) else np.empty((0, TUPLE), np.int64)
    picked.sort(axis=1)  # text order
    value = np.zeros(len(begin), np.uint64)
    for k in range(TUPLE):
        there = picked[:, k] < np.iinfo(np.int64).max
        value = tb.mix(value ^ np.where(there, kmer[np.where(there, picked[:, k], 0)], 0), 10 + k)
    out.reshape(-1)[group[begin]] = (value >> np.uint64(48)) | np.uint64(1 << 16)
    for i in np.flatnonzero((out == 0).any(axis=1) & (lengths > 0)).tolist():
        full = np.flatnonzero(out[i])
        take = full[np.searchsorted(full, np.arange(SLOTS)) % len(full)]
        out[i] = out[i][take]
    return out.astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots."""
    return (a == b).mean(axis=-1)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_DDL = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _columns(texts: list[str], following: list[str]) -> list[pa.Array]:
    """For texts and what follows each."""
    changed = [edited(a, b).encode("utf-8") for a, b in zip(texts, following, strict=True)]
    raw = [t.encode("utf-8") for t in texts]
    n = len(texts)
    chained = n > 1 and all(a is b for a, b in zip(texts[1:], following[:-1], strict=True))
    prints = fingerprints([*raw, *changed, *([following[-1].encode()] if chained else [t.encode() for t in following])])
    own, new = prints[:n], prints[n : 2 * n]
    after = np.concatenate((own[1:], prints[2 * n :])) if chained else prints[2 * n :]
    hexes = [[x.astype("<u2").tobytes().hex() for x in p] for p in (own, new)]
    values = [[len(t) for t in texts], [hashlib.sha256(c).hexdigest() for c in changed], *hexes, likeness(own, new), likeness(own, after)]
    return [pa.array(v, t) for v, t in zip(values, _TYPES, strict=True)]


def _ordered(size: int = 512 << 10):
    """Rows of one range of doc_id in order: results, but for the last row, which needs the next range's first text."""

    @tb.task("order_minhash")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, row_type = TaskContext.get().partitionId(), None
        rows: list = []
        texts: list[str] = []
        held, first = 0, None

        def out(row: list, values: list[pa.Array], kind: str, text: list) -> pa.RecordBatch:
            n = len(row)
            return pa.record_batch([pa.concat_arrays(row), *values, pa.array([kind] * n), pa.array([part] * n, pa.int32()), pa.array(text, pa.string())], names=["__row", *_NAMES, "kind", "part", "text"])

        def nulls(n: int) -> list[pa.Array]:
            return [pa.nulls(n, t) for t in _TYPES]

        for batch in batches:
            row, row_type = batch.column("__row"), batch.column("__row").type
            for i, _, data, offsets in tb.chunks(batch, batch.schema.get_field_index("__text"), size):
                for k, (p, q) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True), i):
                    text = data[p:q].tobytes().decode("utf-8", "replace")
                    if first is None:
                        first = text
                        yield out([row.slice(k, 1)], nulls(1), "head", [text])
                    rows.append(row.slice(k, 1))
                    texts.append(text)
                    held += q - p
                    if (held >= size or len(rows) > 1000) and len(rows) > 1:
                        yield out(rows[:-1], _columns(texts[:-1], texts[1:]), "done", [None] * (len(rows) - 1))
                        rows, texts = rows[-1:], texts[-1:]
                        held = q - p
        if len(rows) > 1:
            yield out(rows[:-1], _columns(texts[:-1], texts[1:]), "done", [None] * (len(rows) - 1))
        if rows:
            yield out(rows[-1:], nulls(1), "tail", texts[-1:])

    return run


@tb.task("order_minhash")
def _last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            for i in range(batch.num_rows):
                yield pa.record_batch([batch.column("__row").slice(i, 1), *_columns([batch.column("text")[i].as_py()], [batch.column("after")[i].as_py()])], names=["__row", *_NAMES])


def order_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint each whole text and its edited text, and compare with the next document's.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document in ascending doc_id order; the first one follows the last. Texts move once, to ranges of doc_id; the
    last text of a range and the first of the next one, two rows a range, meet afterwards.

    Returns the columns of ``docs`` but the text, n_chars (code points), edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next (0 to 1). Columns of these names are replaced. A null text counts as
    empty, and all empty texts have one fingerprint. Rows without doc_id come first; equal doc_ids are ordered by
    text. A single row follows itself; an empty table gives an empty one; nulls elsewhere pass through.
    """
    spark = docs.sparkSession
    shared.lean(spark)
    others = [c for c in docs.columns if c != text]
    row = F.struct(*[F.col(f"`{c}`").alias(c) for c in others])
    rows = docs.select(row.alias("__row"), F.col(f"`{doc_id}`").alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    ranged = rows.repartitionByRange(shared.partitions(spark), "__id").sortWithinPartitions("__id", "__text").drop("__id")
    row_ddl = f"__row {rows.schema['__row'].dataType.simpleString()}"
    seen = shared.keep(ranged.mapInArrow(_ordered(), f"{row_ddl}, {_DDL}, kind string, part int, text string"), "ordered")
    heads = seen.filter("kind = 'head'").select("part", F.col("text").alias("after"))
    parts = heads.select("part")  # one row a range
    following = parts.selectExpr("part", "lead(part) OVER (ORDER BY part) AS next", "min(part) OVER () AS first").selectExpr("part", "coalesce(next, first) AS next")
    tails = seen.filter("kind = 'tail'").select("__row", "text", "part").join(following, "part").join(heads.withColumnRenamed("part", "next"), "next").select("__row", "text", "after")
    done = seen.filter("kind = 'done'").select("__row", *_NAMES)
    return shared.unpacked(done.unionByName(tails.mapInArrow(_last, f"{row_ddl}, {_DDL}")), others, _NAMES)
