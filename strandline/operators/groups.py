"""Groups of frames that are nearly the same and were taken at nearly the same time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import kept
from strandline.operators import skew
from strandline.operators.retrieval import similar_hashes

#: Links that a task holds at most.
MOST_LINKS = 1 << 20
#: Stretches of time whose links go to one task, unless they have more cells than CELLS.
STRETCHES, CELLS = 8, 1 << 16


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Links (a, b) that join the same ids as those given: a is the least id of what hangs together, b each other one."""
    ends = pa.chunked_array([x.column(k) for k in (0, 1) for x in batches]).combine_chunks().dictionary_encode()
    ids, at = ends.dictionary, ends.indices.to_numpy()
    order = pc.sort_indices(ids).to_numpy()
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    a, b = rank[at].reshape(2, -1)
    top = np.arange(len(ids))
    while len(a):
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top[top] != top).any():
            top = top[top]
        a, b = top[a], top[b]
        a, b = a[a != b], b[a != b]
    below = np.flatnonzero(top != np.arange(len(ids)))
    return pa.record_batch([ids.take(pa.array(order[top[below]])), ids.take(pa.array(order[below]))], schema=batches[0].schema)


def _forests(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of links as stars; what a task holds is bounded: stars that stay many are passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > most:
                held = [_stars(held)]
                n = held[0].num_rows
                if n > most // 2:
                    yield held[0]
                    held, n = [], 0
        if n:
            yield _stars(held)

    return run


def _stars_of(links: DataFrame) -> DataFrame:
    return links.select("a", "b").mapInArrow(_forests(MOST_LINKS), links.select("a", "b").schema)


def components(links: DataFrame) -> DataFrame:
    """(id, group) of all ids in ``links`` (a, b): group is the least id that can be reached.

    Each partition's links are made stars first, in bounded memory; partitions whose links lie close together leave few. An id then has
    a star's centre for each partition that it is in, and only centres stay linked. Links that fit into one batch of MOST_LINKS
    are done by one task; more go on in rounds.
    """
    spark = links.sparkSession
    s = _stars_of(links.filter("a <> b"))
    ends = s.select(F.col("b").alias("id"), F.col("a").alias("top")).unionByName(s.select(F.col("a").alias("id"), F.lit(None).cast(s.schema["a"].dataType).alias("top")))
    tops = kept.keep(ends.groupBy("id").agg(F.array_sort(F.collect_set("top")).alias("tops"), F.bool_or(F.col("top").isNull()).alias("is_top")), "tops")
    first = F.coalesce(F.get("tops", F.lit(0)), F.col("id"))
    others = F.when(F.col("is_top"), F.array_append("tops", F.col("id"))).otherwise(F.col("tops"))
    left = kept.keep(tops.select(first.alias("a"), F.explode(others).alias("b")).filter("a <> b").distinct(), "links")
    group = _rounds(left) if left.count() > MOST_LINKS else _stars_of(left.coalesce(1)).select(F.col("b").alias("id"), F.col("a").alias("group"))
    group = kept.keep(group, "groups")
    kept.drop(spark, left)
    out = skew.join_facts(tops.select("id", first.alias("top")), group.withColumnsRenamed({"id": "top"}), ["top"], F.col("id"))
    return out.select("id", F.coalesce("group", "top").alias("group"))


def _rounds(links: DataFrame) -> DataFrame:
    """``components`` without stars.

    Each round every id takes the least id that it is linked with, and that one's own; ends of links that took the same fall
    together, so that at least half of the ids with links are gone after each. Minima are aggregated before they move, and nothing
    but the question whether links are left reaches the driver.
    """
    spark = links.sparkSession
    left = kept.keep(links.filter("a <> b").select("a", "b").distinct(), "links")
    found = None
    while not left.isEmpty():
        ends = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept.keep(ends.groupBy(F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("to")), "least")
        step = kept.keep(least.join(least.select(F.col("id").alias("to"), F.col("to").alias("next")), "to").select("id", F.col("next").alias("to")), "step")
        at = lambda end: step.select(F.col("id").alias(end), F.col("to").alias(f"{end}_to"))
        moved = skew.join_facts(skew.join_facts(left, at("a"), ["a"], F.col("b")), at("b"), ["b"], F.col("a")).select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b"))
        after = kept.keep(moved.filter("a <> b").distinct(), "links")
        if found is None:
            found = step.withColumnRenamed("to", "group")
        else:
            more = skew.join_facts(found, step.select(F.col("id").alias("group"), "to"), ["group"], F.col("id"))
            found = kept.keep(more.select("id", F.coalesce("to", "group").alias("group")), "found")
        kept.drop(spark, left, least)
        left = after
    return found if found is not None else links.select(F.col("a").alias("id"), F.col("b").alias("group")).limit(0)


def near_duplicate_groups(frames: DataFrame, frame_id: str, hash_: str, time: str, within: int, most: int = 3) -> DataFrame:
    """``frames`` and group_id: the least id of the frames that can be reached from one to the next, where the hashes of neighbours
    differ in ``most`` bits or fewer and their times by ``within`` or less (single linkage).

    Frames of one hash and one stretch of time ``within`` long are all linked: they are one cell, however many they are.
    Cells of like hashes are linked within a stretch, and with those of the next stretch if the last frame of the one and the
    first of the other are near enough. So links are between cells only, found by equal keys, and those of some stretches in
    a row are made stars by one task; stretches with many cells are dealt to several. A frame without hash or time
    is a group of its own. Repeated rows stay.
    """
    given = frames.filter(F.col(hash_).isNotNull() & F.col(time).isNotNull())
    key = [F.col(hash_).alias("__hash"), F.floor(F.col(time) / F.lit(within)).alias("__stretch")]
    cells = kept.keep(given.groupBy(*key).agg(F.min(frame_id).alias("__cell"), F.min(time).alias("first"), F.max(time).alias("last")), "cells")
    hashes = cells.select("__hash").distinct()
    like = similar_hashes(hashes.select("__hash", F.col("__hash").alias("same")), "__hash", "same", most).select("a", "b")
    like = like.unionByName(like.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(hashes.select(F.col("__hash").alias("a"), F.col("__hash").alias("b")))
    near = cells.select(F.col("__hash").alias("a"), "__stretch", F.col("__cell").alias("from"), "last").join(like, "a")
    near = near.withColumn("to_stretch", F.explode(F.array(F.col("__stretch"), F.col("__stretch") + 1))).filter("a < b OR to_stretch > __stretch")
    other = cells.select(F.col("__hash").alias("b"), F.col("__stretch").alias("to_stretch"), F.col("__cell").alias("to"), "first")
    links = near.join(other, ["b", "to_stretch"]).filter((F.col("to_stretch") == F.col("__stretch")) | (F.col("first") - F.col("last") <= within))
    block = lambda stretch: F.floor(F.col(stretch) / STRETCHES).alias("block")
    crowded = cells.groupBy(block("__stretch")).agg(F.ceil(F.count("*") / CELLS).alias("parts")).filter("parts > 1")
    dealt = links.select(F.col("from").alias("a"), F.col("to").alias("b"), block("to_stretch")).join(crowded, "block", "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))))
    group = components(dealt.repartition("block", "part"))
    known = cells.join(group, F.col("__cell") == F.col("id"), "left").select("__hash", "__stretch", F.coalesce("group", "__cell").alias("group_id"))
    out = skew.join_facts(frames.withColumn("__hash", key[0]).withColumn("__stretch", key[1]), known, ["__hash", "__stretch"], F.col(frame_id))
    return out.select(*frames.columns, F.coalesce("group_id", F.col(frame_id)).alias("group_id"))
