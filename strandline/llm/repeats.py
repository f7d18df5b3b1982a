"""Repeated windows of texts, found exactly: what substring dedup and suffix-array dedup have in common.

A window is ``window`` consecutive units (words or bytes) of one text. Its anchor is the leftmost position of the least
gram hash among its first ``reach`` positions, so equal windows have equal anchors, wherever they stand. Consecutive
windows that share an anchor form a super window, kept as a mark. An operator says which marks may repeat (``Search``):

1. Marks of all texts are counted by a key; texts without a repeated one are done. Of the others, copies of a whole text
   are merged: they go whole, and one of them stands for all, with its marks beside it.
2. The operator refines the marks of distinct texts; from here on no text is hashed again to find them.
3. Each super window that is left travels as one packed string to the partition of its key, where sorting groups its
   windows and the bytes of grouped windows are compared.
4. Keys with more than ``HOT`` strings do not travel. Their windows are counted by fingerprint, with partial sums, and
   those whose fingerprint repeats are marked where they stand. Then each distinct window of a run of texts is counted
   by a 128-bit digest of its bytes; what is found once only was marked by chance and is taken back. So no task and no
   table ever holds the strings of one key, however many there are.

What is held at a time is bounded: about ``CHUNK`` bytes of texts (or one longer text), about ``SORTED`` bytes of
strings (and one key's, at most some ``HOT``), filters of 128 MB at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import bloom, shared
from strandline.llm import textbytes as tb

#: Strings of one key that are sorted in one place, at most; it does not depend on the size of the data.
HOT = 2048
#: Bytes of texts that are hashed at once, positions whose minima are taken at once (a power of two), and bytes of strings
#: sorted at once.
CHUNK, STRETCH, SORTED = 1 << 18, 1 << 14, 1 << 19
#: A super window: its anchor (number in the text, place), the phrases counted from there, its windows (first start, number),
#: the names of its phrase and of the next one, and the key of its strings. Places are units of the text.
MARK = np.dtype([("i", "<i4"), ("place", "<i4"), ("m", "<i4"), ("start", "<i4"), ("windows", "<i4"), ("name", "<u8"), ("next", "<u8"), ("key", "<u8")])
_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


@dataclass(frozen=True)
class Spec:
    unit: str  # "word" or "byte"
    window: int
    gram: int
    reach: int  # the first positions of a window, of which one is its anchor


class Units:
    """The units of a run of texts, and the byte and unit places of each text."""

    def __init__(self, spec: Spec, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        if spec.unit == "word":
            self.starts, self.ends, self.at = tb.words(data, offsets)
            self.n = len(self.starts)
        else:
            self.at, self.n = offsets, len(data)

    def prefix(self, spec: Spec) -> np.ndarray:
        """Prefix sums, from which the hash of any stretch of units follows."""
        return tb.sums(tb.word_hashes(self.data, self.starts, self.ends) if spec.unit == "word" else tb.byte_values(self.data))

    def plain(self, spec: Spec) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bytes, in which equal windows are equal strings (one blank after each word), and each unit's start and end."""
        if spec.unit == "word":
            return tb.joined_words(self.data, self.starts, self.ends)
        at = np.arange(self.n + 1)
        return self.data.tobytes(), at[:-1], at[1:]

    def texts(self, places: np.ndarray) -> np.ndarray:
        """The text of each unit."""
        return np.searchsorted(self.at, places, "right") - 1


def gram_hashes(spec: Spec, u: Units) -> np.ndarray:
    """A 64-bit hash of the gram at each position; grams of bytes have 16 at most."""
    n = u.n - spec.gram + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if spec.unit == "word":
        return tb.mix(tb.fixed_spans(u.prefix(spec), spec.gram))
    eight = np.ndarray((u.n,), "<u8", np.concatenate((u.data, np.zeros(8, np.uint8))), strides=(1,))  # 8 bytes from each position on
    if spec.gram < 8:
        x = (eight[:n] & np.uint64((1 << 8 * spec.gram) - 1)) * _C1
    else:
        x = eight[:n] * _C1
        x += eight[spec.gram - 8 : spec.gram - 8 + n] * _C2
    x ^= x >> np.uint64(29)
    x *= _C3
    return x


def anchors(spec: Spec, u: Units, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first position, end, anchor) of the runs of positions with one anchor, the least gram of ``reach`` from each on."""
    n = len(grams) - spec.reach + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    low = np.uint32(STRETCH + spec.reach).item().bit_length()
    mask = np.uint32((1 << low) - 1)
    high, place = (grams >> np.uint64(32)).astype(np.uint32) & ~mask, np.arange(STRETCH + spec.reach, dtype=np.uint32)
    begins, found = [], []
    for s in range(0, n, STRETCH):
        part = high[s : s + STRETCH + spec.reach - 1]
        least = tb.running_min(part | place[: len(part)], spec.reach)
        cut = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        begins.append(cut + s)
        found.append((least[cut] & mask).astype(np.int64) + s)
    begin, a = np.concatenate(begins), np.concatenate(found)
    new = np.diff(a, prepend=-1) != 0
    begin, a = begin[new], a[new]
    return begin, np.append(begin[1:], n), a


def within(u: Units, runs: tuple[np.ndarray, np.ndarray, np.ndarray], size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of the anchor, first start, number of starts) for each run: starts of ``size`` units within texts of ``least`` or more."""
    begin, end, a = runs
    text = u.texts(a)
    first = np.maximum(begin, u.at[text])
    number = np.maximum(np.minimum(end, u.at[text + 1] - size + 1) - first, 0)
    number[np.diff(u.at)[text] < least] = 0
    return text, first, number


def window_starts(at: np.ndarray, window: int, n: int) -> np.ndarray:
    """Starts of all windows within texts."""
    edge = np.zeros(n + 1, np.int32)
    fits = np.diff(at) >= window
    np.add.at(edge, at[:-1][fits], 1)
    np.add.at(edge, at[1:][fits] - window + 1, -1)
    return np.flatnonzero(np.cumsum(edge[:n]))


class Search:
    """What an operator adds: the super windows that may repeat, told by counts over all texts."""

    def __init__(self, spec: Spec):
        self.spec = spec

    def marks(self, u: Units) -> tuple[np.ndarray, np.ndarray]:
        """(text, mark) of all anchors of a run of texts, text by text."""
        raise NotImplementedError

    def first_keys(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a mark has a key, its key) of marks; marks whose key is found once only in all texts do not repeat."""
        raise NotImplementedError

    def refine(self, marked: DataFrame) -> tuple[Callable, bytes | None]:
        """From the marks of distinct texts (uid, marks): how a worker tells (uid of each mark, mark) which of them are left;
        and the filter of hot keys, if there are any."""
        raise NotImplementedError


def counted(keys: DataFrame) -> tuple[DataFrame, int]:
    """(key, n) of keys that occur more than once, as a table, and how many there are."""
    table = shared.keep(keys.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1"), "counted")
    return table, table.count()


def counted_filter(keys: DataFrame) -> tuple[bytes, bytes | None]:
    """The filter of keys (key, n) that occur more than once, and that of those that occur more than ``HOT`` times, if any."""
    table, n = counted(keys)
    hot = table.filter(F.col("n") > HOT).select("key")
    n_hot = hot.count()
    out = bloom.build(table, "key", n), bloom.build(hot, "key", n_hot) if n_hot else None
    shared.drop(keys.sparkSession, table)
    return out


def read_marks(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All marks of a binary column, and the place of each row's first one in them (and the end)."""
    data, offsets = tb.column_bytes(column)
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), MARK), (offsets - offsets[0]) // MARK.itemsize


def write_marks(marks: np.ndarray, at: np.ndarray) -> pa.Array:
    data = marks.tobytes()
    return tb.binary_array([data[p:q] for p, q in zip((at[:-1] * MARK.itemsize).tolist(), (at[1:] * MARK.itemsize).tolist(), strict=True)])


def key_batch(keys: np.ndarray) -> pa.RecordBatch:
    """The distinct keys of a run of texts with their numbers."""
    distinct, n = np.unique(keys, return_counts=True)
    return pa.record_batch([tb.long_array(distinct), tb.long_array(n)], names=["key", "n"])


def text_key(data: np.ndarray | bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _first_keys(search: Search):
    @tb.task("repeats")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in tb.chunks(batch, 0, CHUNK):
                has, keys = search.first_keys(search.marks(Units(search.spec, data, offsets))[1])
                yield key_batch(keys[has])

    return run


def _suspects(search: Search, known):
    """Texts that may have a repeated window, with their keys and marks."""

    @tb.task("repeats")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in tb.chunks(batch, 0, CHUNK):
                text, marks = search.marks(Units(search.spec, data, offsets))
                has, keys = search.first_keys(marks)
                ok = has & bloom.passes(known.value, keys)
                text, marks = text[ok], marks[ok]
                hit = np.unique(text[marks["windows"] > 0])
                if len(hit):
                    stay = np.isin(text, hit)
                    at = np.append(np.searchsorted(text[stay], hit), np.count_nonzero(stay))
                    texts = [data[offsets[t] : offsets[t + 1]].tobytes() for t in hit]
                    yield pa.record_batch([tb.binary_array(list(map(text_key, texts))), tb.binary_array(texts), write_marks(marks[stay], at)], names=["h", "__text", "marks"])

    return run


def _picked(batch: pa.RecordBatch, pick: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each mark, mark) of the marks with windows that are left."""
    marks, at = read_marks(batch.column("marks"))
    row = np.repeat(np.arange(batch.num_rows), np.diff(at))
    ok = (marks["windows"] > 0) & pick(batch.column("uid").to_numpy()[row], marks)
    return row[ok], marks[ok]


def _strings(spec: Spec, pick: Callable, hot):
    """Packed strings of the super windows that are left, without those of hot keys."""

    @tb.task("repeats")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids = batch.column("uid").to_numpy()
            row, marks = _picked(batch, pick)
            if hot is not None:
                cold = ~bloom.passes(hot.value, marks["key"])
                row, marks = row[cold], marks[cold]
            for i, j, data, offsets in tb.chunks(batch, batch.schema.get_field_index("__text"), CHUNK):
                here = slice(*np.searchsorted(row, (i, j)).tolist())
                if here.start == here.stop:
                    continue
                u, own, mine = Units(spec, data, offsets), row[here], marks[here]
                s = u.at[own - i] + mine["start"]
                whole, starts, ends = u.plain(spec)
                packs = [whole[p:q] for p, q in zip(starts[s].tolist(), ends[s + mine["windows"] - 2 + spec.window].tolist(), strict=True)]
                yield pa.record_batch([tb.long_array(mine["key"]), tb.long_array(uids[own]), tb.long_array(mine["start"]), tb.binary_array(packs)], names=["key", "uid", "start", "packed"])

    return run


def grouped(data: bytes, b: np.ndarray, e: np.ndarray, row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For windows of strings (bytes b to e of ``data``, in order, each window followed by the next of its string): the
    index of the first equal window. Equal hashes are followed up by comparing bytes, a run of windows at a time."""
    group = np.arange(len(hashes))
    order = np.argsort(hashes)
    ordered = hashes[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    number = np.cumsum(~same[:-1])
    at = np.flatnonzero(same[:-1] | same[1:])
    if not len(at):
        return group
    both = (number[at] << 32) | order[at]
    both.sort()
    index, number = both & 0xFFFFFFFF, both >> 32
    again = np.flatnonzero(number[1:] == number[:-1]) + 1
    mine, other = index[again], index[again - 1]
    by = np.argsort(mine)
    m, o = mine[by], other[by]
    cut = np.flatnonzero((np.diff(m) != 1) | (np.diff(o) != 1) | (np.diff(row[m]) != 0) | (np.diff(row[o]) != 0)) + 1
    first, last = np.concatenate(([0], cut)), np.append(cut, len(m)) - 1
    if all(data[p:q] == data[r:t] for p, q, r, t in zip(b[m[first]].tolist(), e[m[last]].tolist(), b[o[first]].tolist(), e[o[last]].tolist(), strict=True)):
        lead = np.ones(len(index), bool)
        lead[again] = False
        group[index] = index[np.maximum.accumulate(np.where(lead, np.arange(len(index)), 0))]
    else:  # two strings with one hash: group by the strings themselves
        seen: dict[bytes, int] = {}
        for k in index.tolist():
            group[k] = seen.setdefault(data[b[k] : e[k]], k)
    return group


def repeated_windows(spec: Spec, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Units]:
    """For all windows of packed strings: string, start unit, and the index of the first equal window."""
    u = Units(spec, data, offsets)
    v = window_starts(u.at, spec.window, u.n)
    row = u.texts(v)
    plain, starts, ends = u.plain(spec)
    group = grouped(plain, starts[v], ends[v + spec.window - 1], row, tb.fixed_spans(u.prefix(spec), spec.window)[v])
    return row, v, group, u


def distinct_strings(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first string with the same bytes, for each string; how many there are of it)."""
    bytes_, ends = data.tobytes(), offsets.tolist()
    seen: dict[bytes, int] = {}
    first = np.array([seen.setdefault(bytes_[p:q], k) for k, (p, q) in enumerate(zip(ends[:-1], ends[1:], strict=True))], np.int64)
    return first, np.bincount(first, minlength=len(first))[first]


def _runs(row: np.ndarray, v: np.ndarray, flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of maximal runs of flagged consecutive windows of one string."""
    k = np.flatnonzero(flag)
    if not len(k):
        return k, k
    cut = np.flatnonzero((np.diff(k) != 1) | (np.diff(v[k]) != 1) | (np.diff(row[k]) != 0)) + 1
    return k[np.concatenate(([0], cut))], k[np.append(cut, len(k)) - 1]


def _sorted_windows(spec: Spec):
    """Runs of repeated windows, as starts s to e (not included), from strings sorted by key."""

    def flush(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        (batch,) = pa.Table.from_batches(held).combine_chunks().to_batches()
        data, offsets = tb.column_bytes(batch.column("packed"))
        data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
        uid, start = batch.column("uid").to_numpy(), batch.column("start").to_numpy()
        # of equal strings all windows repeat, and one of them stands for all before the others
        first, copies = distinct_strings(data, offsets)
        lead = first == np.arange(len(first))
        sizes = np.diff(offsets)
        kept = data[tb.places(offsets[:-1][lead], sizes[lead])]
        row, v, group, u = repeated_windows(spec, kept, np.concatenate(([0], np.cumsum(sizes[lead]))))
        begin, end = _runs(row, v, (np.bincount(group, minlength=len(v)) > 1)[group] & (copies[lead] == 1)[row])
        single = np.flatnonzero(lead)
        at = start[single][row] + v - u.at[row]
        many = np.flatnonzero(copies > 1)
        number = np.zeros(len(first), np.int64)
        number[single] = np.diff(u.at) - spec.window + 1
        found = [(uid[single][row[begin]], at[begin], at[end] + 1), (uid[many], start[many], start[many] + number[first[many]])]
        return pa.record_batch([tb.long_array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["uid", "s", "e"])

    @tb.task("repeats")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, key_now = 0, None
        for batch in batches:
            keys, (_, offsets) = batch.column("key").to_numpy(), tb.column_bytes(batch.column("packed"))
            ends = [*(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            begin, at = 0, 0
            for end in ends:  # one key's rows at a time, or a run of keys together
                if size + offsets[at] - offsets[begin] > SORTED and keys[at] != key_now:
                    if at > begin:
                        held.append(batch.slice(begin, at - begin))
                    yield flush(held)
                    held, size, begin = [], 0, at
                key_now, at = keys[at], end
            if len(keys) > begin:
                held.append(batch.slice(begin))
                size += int(offsets[-1] - offsets[begin])
        if held:
            yield flush(held)

    return run


def _hot_windows(spec: Spec, pick: Callable, hot, batch: pa.RecordBatch) -> Iterator[tuple[Units, np.ndarray, np.ndarray, np.ndarray]]:
    """(units, row of the batch, start, hash) of all windows of hot keys, for runs of texts; others are not hashed."""
    row, marks = _picked(batch, pick)
    warm = bloom.passes(hot.value, marks["key"])
    row, marks = row[warm], marks[warm]
    texts = np.unique(row)
    for i, j, data, offsets in tb.chunks(batch.take(pa.array(texts)), batch.schema.get_field_index("__text"), CHUNK):
        here = slice(*np.searchsorted(row, (texts[i], texts[j - 1] + 1)).tolist())
        u = Units(spec, data, offsets)
        n = marks["windows"][here].astype(np.int64)
        own = np.searchsorted(texts, row[here]) - i
        v = tb.places(u.at[own] + marks["start"][here], n)
        v.sort()
        yield u, texts[i:j], v, tb.mix(tb.fixed_spans(u.prefix(spec), spec.window)[v], 5)


def _hot_prints(spec: Spec, pick: Callable, hot):
    @tb.task("repeats")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, h in _hot_windows(spec, pick, hot, batch):
                yield key_batch(h)

    return run


def _hot_marks(spec: Spec, pick: Callable, hot, seen):
    """Windows of hot keys whose fingerprint repeats: runs of them (uid, s, e), and with a digest each distinct one."""

    @tb.task("repeats")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "s", "e", "digest", "n"]
        for batch in batches:
            uids = batch.column("uid").to_numpy()
            for u, rows, v, h in _hot_windows(spec, pick, hot, batch):
                again = bloom.passes(seen.value, h)
                v, h = v[again], h[again]
                if not len(v):
                    continue
                text = u.texts(v)
                uid, at = uids[rows[text]], v - u.at[text]
                first, last = _runs(text, v, np.ones(len(v), bool))
                none = np.full(len(first), None)
                yield pa.record_batch([tb.long_array(uid[first]), tb.long_array(at[first]), tb.long_array(at[last] + 1), pa.array(none, pa.binary()), pa.array(none, pa.int64())], names=names)
                plain, starts, ends = u.plain(spec)
                b, e = starts[v], ends[v + spec.window - 1]
                group = grouped(plain, b, e, text, h)
                lead = np.flatnonzero(group == np.arange(len(v)))
                n = np.bincount(group, minlength=len(v))[lead]
                digests = [hashlib.blake2b(plain[p:q], digest_size=16).digest() for p, q in zip(b[lead].tolist(), e[lead].tolist(), strict=True)]
                yield pa.record_batch([tb.long_array(uid[lead]), tb.long_array(at[lead]), pa.array(np.full(len(lead), None), pa.int64()), tb.binary_array(digests), tb.long_array(n)], names=names)

    return run


def _hot_found(distinct: DataFrame, spec: Spec, pick: Callable, hot) -> tuple[DataFrame, DataFrame]:
    """(uid, s, e) of marked runs of windows, and (uid, s, null) of windows that were marked by chance; the table behind them."""
    sc = distinct.sparkSession.sparkContext
    table, n = counted(distinct.mapInArrow(_hot_prints(spec, pick, hot), "key long, n long"))
    seen = sc.broadcast(bloom.build(table, "key", n))
    shared.drop(distinct.sparkSession, table)
    marks = shared.keep(distinct.mapInArrow(_hot_marks(spec, pick, hot, seen), "uid long, s long, e long, digest binary, n long"), "marks")
    once = marks.filter("digest IS NOT NULL").groupBy("digest").agg(F.sum("n").alias("n"), F.min("uid").alias("uid"), F.min("s").alias("s")).filter("n = 1")
    return marks.filter("digest IS NULL").select("uid", "s", "e").unionByName(once.select("uid", "s", F.lit(None).cast("long").alias("e"))), marks


def covered(n: int, at: np.ndarray, window: int, text: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Units covered by the windows that start at s to e (not included) of the texts; a negative e takes a start back."""
    run = e >= 0
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at[text[run]] + s[run], 1)
    np.add.at(edge, at[text[run]] + e[run], -1)
    flag = np.cumsum(edge[:n]) > 0
    flag[at[text[~run]] + s[~run]] = False
    before = np.concatenate((np.zeros(window, np.int64), np.cumsum(flag)))
    return before[window:] > before[: len(before) - window]


def cut_texts(spec: Spec, u: Units, gone: np.ndarray) -> tuple[list, bytes, np.ndarray]:
    """n_units, n_removed and n_spans of each text, and the kept bytes of all with their offsets."""
    data, offsets = u.data, u.offsets
    if spec.unit == "word":
        stay = np.flatnonzero(~gone)
        edge = np.zeros(len(data) + 1, np.int8)
        edge[u.starts[stay]] += 1
        np.add.at(edge, u.ends[stay], -1)
        keep = np.cumsum(edge[:-1], dtype=np.int8) > 0
        text = u.texts(stay)
        joint = u.ends[stay[:-1][text[:-1] == text[1:]]]  # white space between two kept words of one text
        keep[joint] = True
        data = data.copy()
        data[joint] = 0x20
    else:
        keep = ~gone
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    heads = u.at[:-1][np.diff(u.at) > 0]
    begins[heads] = gone[heads]

    def total(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.concatenate(([0], np.cumsum(flags)))[at]

    return [np.diff(u.at), np.diff(total(gone, u.at)), np.diff(total(begins, u.at))], data[keep].tobytes(), total(keep, offsets)


_RESULT_DDL = "n_units long, n_removed long, n_spans long, kept_sha256 string, kept binary"
_RESULT = [x.split()[0] for x in _RESULT_DDL.split(", ")]


def _arrays(spec: Spec, u: Units, gone: np.ndarray, with_kept: bool) -> list[pa.Array]:
    numbers, kept, at = cut_texts(spec, u, gone)
    parts = [kept[p:q] for p, q in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return [*map(tb.long_array, numbers), pa.array([hashlib.sha256(x).hexdigest() for x in parts], pa.string()), pa.array(parts if with_kept else [None] * len(parts), pa.binary())]


def _cut_distinct(spec: Spec, with_kept: bool):
    @tb.task("repeats")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = batch.column("copies").to_numpy() > 1
            ranges, (_, at) = batch.column("ranges"), tb.list_places(batch.column("ranges"))
            s, e = [x.to_numpy(zero_copy_only=False) for x in (tb.field(ranges.values, 0), tb.field(ranges.values, 1).fill_null(-1))]
            for i, j, data, offsets in tb.chunks(batch, batch.schema.get_field_index("__text"), CHUNK):
                u = Units(spec, data, offsets)
                here = slice(at[i], at[j])
                gone = covered(u.n, u.at, spec.window, np.repeat(np.arange(j - i), np.diff(at[i : j + 1])), s[here], e[here])
                gone |= np.repeat(many[i:j] & (np.diff(u.at) >= spec.window), np.diff(u.at))
                yield pa.record_batch([batch.column("h").slice(i, j - i), *_arrays(spec, u, gone, with_kept)], names=["h", *_RESULT])

    return run


def _plain(spec: Spec, with_kept: bool):
    """What each row has if nothing of it repeats, and the key of its text."""

    @tb.task("repeats")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column("__row")
            for i, j, data, offsets in tb.chunks(batch, batch.schema.get_field_index("__text"), CHUNK):
                u = Units(spec, data, offsets)
                keys = [text_key(data[p:q]) for p, q in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.record_batch([row.slice(i, j - i), tb.binary_array(keys), *_arrays(spec, u, np.zeros(u.n, bool), with_kept)], names=["__row", "h", *_RESULT])

    return run


def remove_repeats(docs: DataFrame, text: str, search: Search, with_kept: bool) -> DataFrame:
    """``__row`` (all columns but the text) and n_units, n_removed, n_spans, kept_sha256, kept for each row of ``docs``."""
    spark, spec = docs.sparkSession, search.spec
    sc = spark.sparkContext
    shared.lean(spark)
    packed = shared.packed(docs, text).withColumnRenamed(f"__{text}", "__text")
    others = [c for c in docs.columns if c != text]
    row = F.struct(*[F.col("__row").getField(c).alias(c) for c in others]) if others else F.struct(F.lit(0).alias("__none"))
    rows = packed.select(row.alias("__row"), F.col("__text").cast("binary").alias("__text"))
    known = sc.broadcast(counted_filter(rows.select("__text").mapInArrow(_first_keys(search), "key long, n long"))[0])
    found = rows.select("__text").mapInArrow(_suspects(search, known), "h binary, __text binary, marks binary")
    distinct = shared.keep(found.groupBy("h", "__text", "marks").agg(F.count("*").alias("copies")).withColumn("uid", F.monotonically_increasing_id()), "distinct")
    pick, hot_keys = search.refine(distinct.select("uid", "marks"))
    hot = None if hot_keys is None else sc.broadcast(hot_keys)
    texts = distinct.select("uid", "__text", "marks")
    strings = texts.mapInArrow(_strings(spec, pick, hot), "key long, uid long, start long, packed binary")
    dealt = strings.repartition(shared.partitions(spark), "key").sortWithinPartitions("key")
    runs = dealt.mapInArrow(_sorted_windows(spec), "uid long, s long, e long")
    used = [distinct]
    if hot is not None:
        more, marks = _hot_found(texts, spec, pick, hot)
        runs = runs.unionByName(more)
        used.append(marks)
    ranges = runs.groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("ranges"))
    marked = distinct.join(ranges, "uid", "left").select("h", "__text", "copies", F.coalesce("ranges", F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("ranges"))
    results = shared.keep(marked.filter("size(ranges) > 0 OR copies > 1").mapInArrow(_cut_distinct(spec, with_kept), f"h binary, {_RESULT_DDL}"), "cut")
    shared.drop(spark, *used)
    look = rows.mapInArrow(_plain(spec, with_kept), f"__row {rows.schema['__row'].dataType.simpleString()}, h binary, {_RESULT_DDL}")
    later = results.select(F.col("h").alias("h2"), *[F.col(c).alias(f"{c}2") for c in _RESULT])
    joined = look.join(later, F.col("h") == F.col("h2"), "left")
    return joined.select("__row", *[F.when(F.col("h2").isNotNull(), F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in _RESULT])
