"""Suffix-array dedup by distributed prefix doubling: byte strings of a length that start more than once are cut out.

The sorted positions are the anchors of ``repeats`` (the least gram of some run of ``reach`` positions). Between the first
and the last anchor of a ``length``-byte string all anchors are its own, wherever it stands, and they are ``span`` bytes
apart at least. So texts are cut at anchors into phrases, and doubling goes by phrases:

* round 1 ranks pairs (name of the phrase at a position, of the next one); pairs found once in all texts are taken out before;
* in round r Spark joins each position's rank with the rank of the position 2**(r - 1) phrases on, sorts the distinct
  pairs that repeat, and numbers them in that order: the ranks of the next round;
* a position leaves when its pair is unique, or when its neighbour has left, as then it is unique too;
* a position is past the threshold when its prefix would go beyond ``span`` bytes. Its last pair overlaps, so that its
  last rank stands for all the phrases that fit into ``span``. Positions with very short phrases (runs of one character)
  stop after ``ROUNDS`` rounds.

Strings of ``length`` bytes whose first anchor is left are then sorted and compared byte by byte (``repeats``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import bloom, repeats, shared
from strandline.llm import textbytes as tb

#: Rounds of doubling, at most.
ROUNDS = 4


def spec(length: int = 400) -> repeats.Spec:
    if length < 8:
        raise ValueError("the length must be 8 at least")
    return repeats.Spec("byte", length, min(16, length // 8), length // 5)


def span(spec: repeats.Spec) -> int:
    """Bytes between the first and the last anchor of a string, at least."""
    return spec.window + 2 - spec.gram - 2 * spec.reach


def position_ids(uids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """One number for each position of all texts; only a filter is built of them."""
    return tb.mix(tb.mix(uids.astype(np.uint64), 6) + places.astype(np.uint64), 7)


@tb.task("repeats")
def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each mark."""
    for batch in batches:
        marks, at = repeats.read_marks(batch.column("marks"))
        uid = np.repeat(batch.column("uid").to_numpy(), np.diff(at))
        longs = [uid, marks["i"], marks["m"], position_ids(uid, marks["place"]), marks["key"], marks["name"], marks["next"]]
        yield pa.record_batch([*map(tb.long_array, longs), pa.array(marks["windows"] > 0)], names=["uid", "i", "m", "id", "key", "ra", "rb", "own"])


def doubled(positions: DataFrame) -> DataFrame:
    """(id, key) of the positions with windows of their own whose last ranks are shared."""
    spark = positions.sparkSession
    parts, done = shared.partitions(spark), []
    pairs = positions.withColumn("off", F.lit(1).cast("long"))
    for r in range(1, ROUNDS + 1):
        width = 1 << r
        repeated = pairs.groupBy("ra", "rb", "off").agg(F.count("*").alias("shared")).filter("shared > 1")
        order = ("ra", "rb", "off")
        ranks = shared.keep(repeated.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(*order, F.monotonically_increasing_id().alias("rank")), "ranks")
        left = shared.keep(pairs.join(ranks, list(order)).select("uid", "i", "m", "id", "key", "own", "rank"), "positions")
        shared.drop(spark, ranks)
        over = F.col("m") <= width
        done.append(left.filter(over & F.col("own")).select("id", "key"))
        more = left.filter(~over)
        if r == ROUNDS or more.isEmpty():
            done.append(more.filter("own").select("id", "key"))
            break
        # the ranks of this round, those of prefixes that end too early for it left out, meet their neighbours'
        whole = left.filter(F.col("m") >= width)
        ahead = more.withColumn("off", F.least(F.lit(width), F.col("m") - width)).withColumn("at", F.col("i") + F.col("off")).withColumnRenamed("rank", "ra")
        pairs = ahead.join(whole.select("uid", F.col("i").alias("at"), F.col("rank").alias("rb")), ["uid", "at"]).drop("at")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


class Doubling(repeats.Search):
    def marks(self, u: repeats.Units) -> tuple[np.ndarray, np.ndarray]:
        spec = self.spec
        grams = repeats.gram_hashes(spec, u)
        runs = repeats.anchors(spec, u, grams)
        text, start, n = repeats.within(u, runs, spec.window, spec.window)
        chain = repeats.within(u, runs, spec.reach + spec.gram - 1, spec.window)[2] > 0
        a, text, start, n = runs[2][chain], text[chain], start[chain], n[chain]
        out = np.zeros(len(a), repeats.MARK)
        if not len(a):
            return text, out
        k = np.arange(len(a))
        first, last = np.searchsorted(text, text), np.searchsorted(text, text, "right") - 1
        m = np.minimum(np.searchsorted(a, a + span(spec), "right") - 1, last) - k
        names = tb.mix(np.add.reduceat(grams, a))  # of a phrase with the grams that begin in it
        out["i"], out["place"], out["m"], out["start"], out["windows"] = k - first, a - u.at[text], m, np.where(n > 0, start - u.at[text], 0), n
        out["name"], out["next"] = names, names[np.minimum(k + 1, last)]
        out["key"] = tb.mix(tb.spans(tb.sums(names), k, k + m), 3)
        return text, out

    def first_keys(self, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return marks["m"] >= 2, tb.mix(marks["name"], 1) ^ tb.mix(marks["next"], 2)

    def refine(self, marked: DataFrame) -> tuple[Callable, bytes | None]:
        spark = marked.sparkSession
        positions = marked.mapInArrow(_positions, "uid long, i long, m long, id long, key long, ra long, rb long, own boolean")
        left = shared.keep(doubled(positions), "doubled")
        ids = spark.sparkContext.broadcast(bloom.build(left, "id", left.count()))
        hot = left.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > repeats.HOT)
        n_hot = hot.count()
        hot_keys = bloom.build(hot, "key", n_hot) if n_hot else None
        shared.drop(spark, left)
        return lambda uids, marks: bloom.passes(ids.value, position_ids(uids, marks["place"])), hot_keys


def suffix_dedup(docs: DataFrame, text: str = "text", length: int = 400, with_text: bool = True) -> DataFrame:
    """Cut each byte covered by a ``length``-byte string that starts anywhere else too, in the same row or another.

    Prefix doubling over sampled suffixes, as described above: Spark sorts pairs of ranks at growing offsets and ranks
    them anew, until a position is unique or past the threshold; the strings of those past it are compared byte by byte.
    Positions are such that any ``length``-byte string has one in its head, so none is missed.

    Returns the columns of ``docs`` with ``text`` replaced by binary ``kept`` (left out without ``with_text``), and
    n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256. Columns of these names are replaced.
    A null text counts as empty; a shorter text stays whole; rows with equal texts, repeated rows too, are copies
    of each other; an empty table gives an empty one; nulls elsewhere pass through. ``length`` is 8 at least.
    One text of n bytes, and what is worked out of it, must fit into a worker's memory (about 150 n).
    """
    out = repeats.remove_repeats(docs, text, Doubling(spec(length)), with_text).withColumnRenamed("n_units", "n_bytes")
    return shared.unpacked(out, docs.columns, ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])], (text,))
