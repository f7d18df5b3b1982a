"""Runs of periodic words in whole texts: found by counting matches at each lag, and collapsed to their first period.

A run of period q is a longest stretch of words in which words q apart are identical, of ``least`` words and ``times`` periods
or more, and without a smaller period. For each text:

1. Matches at all lags are counted. Words that occur seldom give the differences of their places; those that occur often give
   the autocorrelation of their places, by Fourier transforms rounded to whole numbers. A word is counted the cheaper way.
2. A run of period q has ``need(q)`` matches at lag q, so only lags with as many are looked at. Matches inside the runs found
   so far are taken off at multiples of their periods: two runs share less than q words if both their periods divide q, so
   no match is taken off twice, and a text that repeats one word does not have all its lags looked at.
3. Islands of matches are searched at those lags: places an eighth of the lag apart first, and all of them only where these
   leave room for an island.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import shared
from strandline.llm import textbytes as tb

#: Differences of places that are held before they are counted.
_HELD = 1 << 20
#: Places that are looked at in a lag before all are.
_SAMPLES = 8

Rewrite = Callable[[int | None, int], np.ndarray | None]


def need(lag, least: int, times: int):
    """Matches at its period that a run has at least."""
    return np.maximum(least - lag, (times - 1) * lag)


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal words only."""
    sizes = ends - starts
    packed = data[tb.places(starts, sizes)]
    at = np.concatenate(([0], np.cumsum(sizes)))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(packed)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def lag_counts(words: np.ndarray, at: np.ndarray, lags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matches at lags 0 to lags[t] of each text t, one text after the other, and where each text's begin.

    ``words`` are the numbers of all texts' words, ``at`` the first word of each text (and the end). Lag 0 is not counted.
    """
    n = np.diff(at)
    base = np.concatenate(([0], np.cumsum(lags + 1)))
    counts = np.zeros(base[-1], np.int64)
    text = np.repeat(np.arange(len(n)), n)
    key = text * (int(words.max(initial=0)) + 1) + words
    place = np.argsort(key, kind="stable")
    key = key[place]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    often = np.diff(np.append(first, len(key)))
    owner = text[place[first]]
    width = np.left_shift(1, np.ceil(np.log2(np.maximum(n + lags, 2))).astype(np.int64))[owner]
    # a difference costs some ten times what a step of a transform does, and a transform has its fixed cost
    heavy = often * often > width * np.log2(width) / 4 + 20_000
    for t in np.unique(owner[heavy]).tolist():
        groups = np.flatnonzero(heavy & (owner == t))
        power = 0.0
        for g in groups.tolist():
            signal = np.zeros(int(width[g]))
            signal[place[first[g] : first[g] + often[g]] - at[t]] = 1
            power = power + np.abs(np.fft.rfft(signal)) ** 2
        same = np.rint(np.fft.irfft(power, int(width[groups[0]]))[: lags[t] + 1]).astype(np.int64)
        counts[base[t] + 1 : base[t] + 1 + lags[t]] += same[1:]
    rest = np.repeat(~heavy, often)
    last = np.repeat(first + often - 1, often)[rest]
    i, step, held, size = np.flatnonzero(rest), 0, [], 0
    while len(i):
        step += 1
        go = i + step <= last
        i, last = i[go], last[go]
        apart = place[i + step] - place[i]
        near = apart <= lags[text[place[i]]]  # differences rise with each step
        i, last, apart = i[near], last[near], apart[near]
        held.append(base[text[place[i]]] + apart)
        size += len(apart)
        if size > _HELD:
            counts += np.bincount(np.concatenate(held), minlength=len(counts))
            held, size = [], 0
    if size:
        counts += np.bincount(np.concatenate(held), minlength=len(counts))
    return counts, base


def islands(words: np.ndarray, lag: int, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of period ``lag`` with ``enough`` matches in a row."""
    step = max(1, lag // _SAMPLES)
    if step > 1:
        other = np.flatnonzero(words[:-lag:step] != words[lag::step])
        if np.diff(other, prepend=-1, append=-(-(len(words) - lag) // step)).max() - 1 < enough // step:
            return other[:0], other[:0]
    other = np.concatenate(([-1], np.flatnonzero(words[:-lag] != words[lag:]), [len(words) - lag]))
    k = np.flatnonzero(np.diff(other) - 1 >= enough)
    return other[k] + 1, other[k + 1] + lag


def runs(words: np.ndarray, counts: np.ndarray, least: int = 6, times: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one text, by start and period; ``counts`` are its matches by lag."""
    lag = np.arange(len(counts))
    enough = need(lag, least, times)
    explained = np.zeros(len(counts), np.int64)
    found: dict[tuple[int, int], int] = {}
    for p in (np.flatnonzero(counts[1:] >= enough[1:]) + 1).tolist():
        if counts[p] - explained[p] < enough[p]:
            continue
        for start, end in zip(*[x.tolist() for x in islands(words, p, int(enough[p]))], strict=True):
            if (start, end) not in found:
                found[start, end] = p
                multiples = lag[p : end - start : p]
                explained[multiples] += end - start - multiples
    return sorted((s, e - s, p) for (s, e), p in found.items())


def repeated(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words stand in a run after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) > 0


def longest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    return min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ADDED = {"n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string(), "runs": pa.list_(_RUN), "collapsed": pa.string()}
_DDL = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _find(ids: list, data: np.ndarray, offsets: np.ndarray, least: int, times: int, rewrite: Rewrite | None, keep: bool) -> list[pa.Array]:
    starts, ends, at = tb.words(data, offsets)
    n = np.diff(at)
    index = np.arange(len(starts))
    for t, i in enumerate(ids if rewrite else ()):
        other = rewrite(i, int(n[t])) if n[t] else None
        if other is not None:
            index[at[t] : at[t + 1]] = at[t] + other
    numbers = word_numbers(data, starts, ends)[index]
    lags = np.where(n >= least, n // times, 0)
    counts, base = lag_counts(numbers, at, lags)
    lag = np.arange(len(counts)) - np.repeat(base[:-1], lags + 1)
    some = np.bincount(np.repeat(np.arange(len(n)), lags + 1), (lag > 0) & (counts >= need(lag, least, times)), len(n)) > 0
    found: list[list] = [[]] * len(n)
    stays = np.ones(len(index), bool)
    for t in np.flatnonzero(some).tolist():
        p, q = int(at[t]), int(at[t + 1])
        found[t] = runs(numbers[p:q], counts[base[t] : base[t + 1]], least, times)
        stays[p:q] = ~repeated(found[t], q - p)
    kept = index[stays]
    joined, begin, end = tb.joined_words(data, starts[kept], ends[kept])
    edge = np.concatenate(([0], np.cumsum(stays)))[at].tolist()
    texts = [joined[begin[a] : end[b - 1]] if b > a else b"" for a, b in zip(edge[:-1], edge[1:], strict=True)]
    best = [longest(f) or (None, None, None) for f in found]
    columns = [
        [len(f) for f in found], *[[b[k] for b in best] for k in range(3)], [1000 * b[1] // b[2] if b[2] else None for b in best],
        [hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in f).encode()).hexdigest() for f in found], [hashlib.sha256(x).hexdigest() for x in texts],
    ]
    columns += [[[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found], [x.decode() for x in texts]] if keep else [[None] * len(n)] * 2
    return [pa.array(c, t) for c, t in zip(columns, _ADDED.values(), strict=True)]


def _run(least: int, times: int, rewrite: Rewrite | None, keep: bool):
    @tb.task("periodic")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ids = batch.column("__row"), batch.column("__id").to_pylist()
            for i, j, data, offsets in tb.chunks(batch, batch.schema.get_field_index("__text")):
                yield pa.record_batch([row.slice(i, j - i), *_find(ids[i:j], data, offsets, least, times, rewrite, keep)], names=["__row", *_ADDED])

    return run


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 6, times: int = 4, rewrite: Rewrite | None = None, with_text: bool = True) -> DataFrame:
    """The columns of ``docs``; n_runs; start, length, period and exponent_milli (1000 times length by period, rounded down) of the
    longest run (ties: smallest start, then period); the SHA-256 of ``start,length,period`` and a line feed for each run, by
    start and period, and of the words that stay, joined by one blank; with ``with_text`` also all runs and that text, collapsed.

    A word goes if any run contains it after that run's first period. ``rewrite`` may give, for a doc_id and a number of
    words, the original word that is taken at each place. ``least`` is positive and ``times`` 2 or more.

    A null text has no words; without a run, the longest run's columns are null. A row without doc_id, and repeated rows, are
    rows like any other. Columns of these names are replaced. An empty table gives an empty one. A text is one task's
    work and, with some 100 bytes for each of its own, must fit there; nothing is shuffled.
    """
    if least < 1 or times < 2:
        raise ValueError("runs have a word at least, and two periods")
    shared.lean(docs.sparkSession)
    columns = [c for c in docs.columns if with_text or c != text]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__row"), F.col(f"`{doc_id}`").cast("long").alias("__id"), F.col(f"`{text}`").alias("__text"))
    out = rows.mapInArrow(_run(least, times, rewrite, with_text), f"__row {rows.schema['__row'].dataType.simpleString()}, {_DDL}")
    return shared.unpacked(out, columns, list(_ADDED) if with_text else list(_ADDED)[:-2])


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Of a tenth of all documents, by the CRC-32 of the decimal id, the end is made periodic; rows without id stay as they are."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate((np.arange(a), a + np.arange(n - a) % p))
