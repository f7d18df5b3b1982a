"""Width and height from the header of a JPEG, without decoding it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of the format: markers of frame headers, and markers without a length.
_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
_BARE = {0x01, *range(0xD0, 0xD8)}


def dimensions(data: bytes) -> tuple[int, int] | None:
    """(width, height) of the first frame header, or None."""
    if data[:2] != b"\xff\xd8":
        return None
    at, end = 2, len(data)
    while at + 4 <= end:
        if data[at] != 0xFF:
            return None
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in _BARE:
            at += 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if marker in _FRAMES:
            if size < 8 or at + 9 > end:
                return None
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        if marker in (0xD9, 0xDA) or size < 2:
            return None
        at += 2 + size
    return None


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [None if c is None else dimensions(c) for c in batch.column("__content").to_pylist()]
        yield pa.record_batch([batch.column("__row"), *[pa.array([f and f[k] for f in found], pa.int32()) for k in (0, 1)]], names=["__row", "width", "height"])


def with_dimensions(df: DataFrame, content: str = "content") -> DataFrame:
    """The columns of ``df`` but the content, width and height (null where there is no readable header)."""
    others = [c for c in df.columns if c not in (content, "width", "height")]
    rows = df.selectExpr(f"struct({', '.join(f'`{c}`' for c in others)}) AS __row", f"`{content}` AS __content")
    return rows.mapInArrow(_sizes, f"__row {rows.schema['__row'].dataType.simpleString()}, width int, height int").select("__row.*", "width", "height")
