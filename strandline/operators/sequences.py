"""Sequences of events with other events between them: seen, in hand, moved, gone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: How many times the longest match a stretch of time is, so that few rows are copied into the stretch before their own.
STRETCH = 8


def gapped_sequences(events: DataFrame, by: str, kind: str, time: str, steps: list[str], gaps: list[int], breaks: list[str] = ()) -> DataFrame:
    """Rows at which a sequence of ``steps`` (kinds) begins, and sequence_end: the earliest time at which it can have ended.

    Each step comes after the one before it, by its gap at most; what happens between does not matter, unless it is one of
    ``breaks``: a sequence has none after its first event, up to the time of its last. ``gaps`` has one gap fewer than there
    are steps; times are whole numbers. Rows without time or group begin nothing and end nothing; repeated rows each begin.

    Time is cut into stretches longer than the longest match, and a row also stands in the stretch before if a match that begins
    there can reach it, so that a group with very many rows is the work of many tasks. From the last step to the first, the
    earliest end of what follows within a gap is a window over a range of time: one shuffle, no loop over rows.
    """
    if len(gaps) != len(steps) - 1 or min(gaps, default=1) < 1 or set(breaks) & set(steps):
        raise ValueError("a positive gap between each two steps, and breaks that are no steps")
    reach = sum(gaps)
    width = STRETCH * max(reach, 1)
    used = events.filter(F.col(by).isNotNull() & F.col(time).isNotNull() & F.col(kind).isin([*steps, *breaks]))
    own = F.floor(F.col(time) / F.lit(width))
    row = used.select(F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("__row"), F.col(by).alias("__by"), F.col(kind).alias("__kind"), F.col(time).cast("long").alias("__t"), own.alias("__own"))
    before = F.when(F.col("__t") - F.col("__own") * width <= reach, F.array(F.col("__own") - 1, F.col("__own"))).otherwise(F.array("__own"))
    x = row.withColumn("__stretch", F.explode(before)).repartition("__by", "__stretch")
    here = Window.partitionBy("__by", "__stretch").orderBy("__t")
    x = x.withColumn("__epoch", F.count_if(F.col("__kind").isin(list(breaks))).over(here.rangeBetween(Window.unboundedPreceding, 0)) if breaks else F.lit(0))
    after = Window.partitionBy("__by", "__stretch", "__epoch").orderBy("__t")
    end = F.when(F.col("__kind") == steps[-1], F.col("__t"))
    for k in range(len(steps) - 2, -1, -1):
        x = x.withColumn(f"__end{k + 1}", end)
        end = F.when(F.col("__kind") == steps[k], F.min(f"__end{k + 1}").over(after.rangeBetween(1, gaps[k])))
    found = x.withColumn("sequence_end", end).filter((F.col("__stretch") == F.col("__own")) & F.col("sequence_end").isNotNull())
    return found.select("__row.*", "sequence_end")
