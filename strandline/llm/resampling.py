"""Target-distribution importance resampling: documents drawn by how much their words look like those of a target.

Features are runs of words, hashed into buckets. A bucket's gain is the logarithm, in thousandths, of its share of the target's
features by its share of the corpus', and a document's weight the sum of gains over its features. Gumbel noise of the doc_id
on top makes the highest scores a draw without replacement.

Equal texts are one group: whole texts are grouped by Spark, features and weight are worked out once for each, and their counts are
multiplied by the number of copies. What is kept of a distinct text is its SHA-256 and its buckets, so the second pass, after
the gains are known, reads no text. Weights go back to the documents by that digest, a hot one over many tasks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import shared
from strandline.llm import textbytes as tb

#: Tasks that copies of one text are dealt to.
SALTS = 256
#: Bytes of words: digits, lower-case letters (upper-case ones become these first), and all beyond ASCII.
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: Columns that the operator adds.
ADDED = ("n_features", "weight", "score", "rank")


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in lower-cased bytes, and the index of each text's first word (and the end)."""
    inside = _INSIDE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1] & ~edge[1:-1])))
    ends = np.flatnonzero(inside & ~np.concatenate((inside[1:] & ~edge[1:-1], [False]))) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def buckets_of(data: np.ndarray, offsets: np.ndarray, most_words: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each feature, one text after the other; features and words of each text."""
    data = _LOWER[data]
    starts, ends, at = _words(data, offsets)
    joined, begin, end = tb.joined_words(data, starts, ends)
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    found, owner = [], []
    for size in range(1, most_words + 1):
        first = np.flatnonzero(np.arange(len(starts)) + size <= at[1:][text])
        stops = end[first + size - 1]
        lengths = stops - begin[first]
        packed = np.frombuffer(joined, np.uint8)[tb.places(begin[first], lengths)]
        cuts = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(cuts), pa.py_buffer(packed)]).dictionary_encode()
        number = np.fromiter((zlib.crc32(x) % buckets for x in coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
        found.append(number[coded.indices.to_numpy()])
        owner.append(text[first])
    bucket, owner = np.concatenate(found), np.concatenate(owner)
    if most_words > 1:
        order = np.argsort(owner, kind="stable")
        bucket, owner = bucket[order], owner[order]
    return bucket, np.bincount(owner, minlength=len(n)), n


def _features(most_words: int, buckets: int):
    @tb.task("resampling")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in tb.chunks(batch, batch.schema.get_field_index("text")):
                bucket, sizes, n = buckets_of(data, offsets, most_words, buckets)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(bucket.astype(np.int32)))
                yield pa.record_batch([batch.column("digest").slice(i, j - i), batch.column("copies").slice(i, j - i), tb.long_array(n), lists], names=["digest", "copies", "n_words", "buckets"])

    return run


def distinct_features(texts: DataFrame, most_words: int, buckets: int) -> DataFrame:
    """digest, copies, n_words and the bucket of each feature: one row for each distinct ``text``, grouped by the text itself."""
    groups = texts.groupBy("text").agg(F.count("*").alias("copies")).select(_digest("text").alias("digest"), "copies", "text")
    return groups.mapInArrow(_features(most_words, buckets), "digest binary, copies long, n_words long, buckets array<int>")


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text, 256))


def _counted(buckets: int):
    @tb.task("resampling")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            values, at = tb.list_places(batch.column("buckets"))
            copies = np.repeat(batch.column("copies").to_numpy(), np.diff(at))
            np.add.at(total, values.to_numpy()[at[0] : at[-1]], copies)
        k = np.flatnonzero(total)
        yield pa.record_batch([pa.array(k), pa.array(total[k])], names=["bucket", "n"])

    return run


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features of all texts by bucket, copies counted: each task adds its own up, and ``buckets`` numbers reach the driver."""
    out = np.zeros(buckets, np.int64)
    for k, n in features.select("copies", "buckets").mapInArrow(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[k] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((t + 1) * (S + B) / ((s + 1) * (T + B)))) of each of B buckets, in doubles."""
    size, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weighed(gain: np.ndarray):
    @tb.task("resampling")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = tb.list_places(batch.column("buckets"))
            total = np.concatenate(([0], np.cumsum(gain[values.to_numpy()[at[0] : at[-1]]])))[at - at[0]]
            yield pa.record_batch([batch.column("digest"), batch.column("n_words"), tb.long_array(np.diff(at)), tb.long_array(np.diff(total))], names=["digest", "n_words", "n_features", "weight"])

    return run


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, first: list[Column]) -> DataFrame:
    """``rows`` with ``place`` (from 1) in the order of ``first``, without one task that sees them all.

    Ranges of the order are sorted apart, and a row's place is its place there and the rows of the ranges before, of which
    there are as many as shuffle partitions. Rows that are equal in the order follow each other in some order.
    """
    spark = rows.sparkSession
    tie = F.monotonically_increasing_id()  # of a kept table: repeated rows do not all fall into one range
    spread = rows.withColumn("__tie", tie).repartitionByRange(shared.partitions(spark), *first, "__tie").sortWithinPartitions(*first, "__tie").drop("__tie")
    kept = shared.keep(spread.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["__part"], total))
        total += r["n"]
    starts = spark.createDataFrame(before, "__part long, __before long")
    here = kept.withColumn("__part", part).withColumn("__own", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)))
    return here.join(F.broadcast(starts), "__part").withColumn("place", F.col("__before") + F.col("__own") + 1).drop("__part", "__own", "__before", "__at")


def importance_resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", most_words: int = 1, buckets: int = 10_000, least_words: int = 20, part: tuple[int, int] = (10, 100), seed: str = "2024"
) -> DataFrame:
    """doc_id, the other columns of ``docs`` but the text, n_features, weight, score and rank of every document.

    Features are all runs of 1 to ``most_words`` words. Of the N documents with ``least_words`` words or more, the
    floor(part[0] * N / part[1]) highest scores are drawn and ranked from 1; ties go to the smaller doc_id, the others have no rank.

    A null text, in either table, has no words and so no features and a weight of 0. Rows without doc_id share the noise of the
    string "null" and come last of equal scores; repeated rows are drawn one by one, equal ones in any order. Columns named
    n_features, weight, score or rank are replaced. Empty tables are fine: without documents there are no rows, without a
    target all is told by the corpus alone. Distinct texts and ids are shuffled; of counts, ``buckets`` numbers reach the driver.
    """
    spark = docs.sparkSession
    shared.lean(spark)
    others = [c for c in docs.columns if c not in (text, doc_id, *ADDED)]
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = shared.keep(distinct_features(docs.select(body.alias("text")), most_words, buckets), "texts")
    wanted = distinct_features(target.select(F.coalesce(F.col(f"`{target_text}`"), F.lit("")).alias("text")), most_words, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    weights = found.mapInArrow(_weighed(gain), "digest binary, n_words long, n_features long, weight long")
    rows = docs.select(
        F.struct(F.col(f"`{doc_id}`").alias(doc_id), *[F.col(f"`{c}`") for c in others]).alias("__row"), F.col(f"`{doc_id}`").alias("__id"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
    ).withColumn("salt", F.pmod(F.xxhash64("__id"), F.lit(SALTS)))
    pairs = shared.over_salts(rows, "digest", "salt", F.count("*").alias("n"), F.sum("n").alias("n"))
    scored = rows.join(pairs.select("digest", "salt").join(weights, "digest"), ["digest", "salt"]).drop("digest", "salt")
    scored = shared.keep(scored.withColumn("score", F.col("weight") + noise(F.col("__id"), seed)), "scored")
    n = scored.filter(F.col("n_words") >= least_words).count()
    out = ranked(scored, [F.col("n_words") < least_words, F.desc("score"), F.asc_nulls_last("__id")])
    out = out.withColumn("rank", F.when(F.col("place") <= part[0] * n // part[1], F.col("place")))
    return shared.unpacked(out, [doc_id, *others], list(ADDED))
