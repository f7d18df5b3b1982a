"""Whole Arrow text columns as byte arrays: words, rolling hashes and window minima in numpy."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Base of the polynomial hashes: odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
#: Bytes that separate words: blank, and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = {"n": 0, "up": np.empty(0, U64), "down": np.empty(0, U64)}


#: What a worker process keeps between tasks: by operator, how to let go of it.
kept: dict[str, Callable[[], None]] = {}


def task(owner: str):
    """Of a map over Arrow batches: other operators' kept objects go first, and freed memory is given back at the end.

    Workers are used again by later stages, so what one operator leaves behind would add to the next one's needs.
    """

    def wrap(run):
        @functools.wraps(run)
        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name in [n for n in kept if n != owner]:
                kept.pop(name)()
            try:
                yield from run(batches)
            finally:
                give_back()

        return go

    return wrap


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i below n."""
    if _powers["n"] < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", BASE), ("down", _INVERSE)):
            steps = np.full(size, U64(base), U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE**i; ``spans`` takes hashes of any stretch from them."""
    out = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def spans(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (prefix[end] - prefix[start]) * powers(len(prefix))[1][start]


def fixed_spans(prefix: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all stretches of one length."""
    n = max(0, len(prefix) - length)
    return (prefix[length:] - prefix[:n]) * powers(len(prefix))[1][:n]


def byte_values(data: np.ndarray) -> np.ndarray:
    return _BYTES[data]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its offsets; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), at


def list_places(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column without nulls, and the place of each row's first one in them (and the end)."""
    return column.values, column.offsets.to_numpy().astype(np.int64)


def field(rows: pa.StructArray, k: int) -> pa.Array:
    """Member k of a struct column, without a copy."""
    return pc.struct_field(rows, [k])


def chunks(batch: pa.RecordBatch, column: int | pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    data, at = column_bytes(batch.column(column) if isinstance(column, int) else column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, min(int(np.searchsorted(at, at[i] + limit, "right")) - 1, n))
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a run of texts, and the index of each text's first word (and the end)."""
    inside = ~SPACE[data]
    before = np.empty_like(inside)
    before[1:], before[:1] = inside[:-1], False
    after = np.empty_like(inside)
    after[:-1], after[-1:] = inside[1:], False
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    before[cuts], after[cuts - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one blank after each, and their starts and ends there."""
    sizes = ends - starts
    at = np.cumsum(sizes + 1) - sizes - 1
    out = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    out[places(at, sizes)] = data[places(starts, sizes)]
    return out.tobytes(), at, at + sizes


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, one after the other."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(len(out), dtype=out.dtype)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(spans(sums(byte_values(data)), starts, ends))


def running_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i : i + width] for each i, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def long_array(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == U64 else values.astype(np.int64), pa.int64())


def binary_array(parts: list) -> pa.Array:
    return pa.array(parts, pa.binary())
