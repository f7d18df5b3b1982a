"""A Bloom filter of bounded size over 64-bit keys, built by Spark's bitmap aggregates and read in numpy.

False positives only make later steps move more rows; results never depend on the filter alone.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits for each key, and the least and the largest size as powers of two (2**30 bits: 128 MB). Beyond that
#: size the filter fills up and lets more pass, so that later steps move more, with the same results.
BITS_PER_KEY, LEAST, MOST = 32, 20, 30
_SHIFTS = (0, 17, 34)


def build(keys: DataFrame, column: str, n: int) -> bytes:
    """The filter over the ``n`` well mixed long values of a column; at most 2**(MOST - 3) bytes reach the driver."""
    bits = min(MOST, max(LEAST, (max(n, 1) * BITS_PER_KEY - 1).bit_length()))
    places = F.array(*[F.shiftrightunsigned(F.col(column), s).bitwiseAND(F.lit((1 << bits) - 1)) + 1 for s in _SHIFTS])
    b = keys.select(F.explode(places).alias("b"))
    rows = b.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for k, m in rows.toLocalIterator():
        out[(k - 1) * 4096 : k * 4096] = np.frombuffer(bytes(m), np.uint8)
    return out.tobytes()


def passes(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    table = np.frombuffer(filter_bytes, np.uint8)
    mask = np.uint64(len(table) * 8 - 1)
    ok = np.ones(len(keys), bool)
    for s in _SHIFTS:
        b = (keys >> np.uint64(s)) & mask
        ok &= (table[(b >> np.uint64(3)).astype(np.int64)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok
