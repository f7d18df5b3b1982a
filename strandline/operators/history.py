"""Searches through a history that is partitioned by time, which read only the periods that can hold an answer.

Beside the partitions lies a summary of each: rows, first and last time, best score, and a Bloom filter of its objects, as bitmaps of
32768 bits. A search goes from period to period, newest or oldest first, asks the summary which of the objects still looked
for a period may hold with a score that counts, and reads it only if there are any. What it may hold wrongly costs a read.

Periods are taken one, two, four, ... at a time, so the jobs in a row grow with the logarithm of a history (from ``BATCH`` periods
on, with a ``BATCH``-th of it), and what is read is some twice what a search of one period after the other would read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline import kept
from strandline.functions import scalars

#: Length of the name of a period: yyyy-MM or yyyy-MM-dd; bits of a filter, and bits set for an object.
MONTH, DAY = 7, 10
BITS, HASHES = 1 << 20, 3
#: Periods of a step at most: their filters are broadcast, 16 MB. Rows of a file, about.
BATCH, FILE = (16 << 20) // (BITS // 8), 1 << 18


def period_of(time_ms: Column, length: int = MONTH) -> Column:
    """The name of a time's month or day, in UTC."""
    return F.substring(scalars.utc_day(time_ms.cast("long")).cast("string"), 1, length)


def _bits(by: str) -> Column:
    """The places of an object's bits, from 1."""
    return F.array(*[F.pmod(F.xxhash64(F.col(by), F.lit(k)), F.lit(BITS)) + 1 for k in range(HASHES)])


def write_history(df: DataFrame, path: str, by: str, time: str, score: str, length: int = MONTH) -> None:
    """Partitions and summaries of the periods that occur in ``df``; they replace those periods, and no others.

    Rows without time have no period and are not kept.
    """
    x = df.filter(F.col(time).isNotNull()).withColumn("period", period_of(F.col(time), length))
    dynamic = lambda d: d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period")
    counts = {r["period"]: r["count"] for r in x.groupBy("period").count().collect()}  # one row for each period
    periods, files = list(counts), max(counts.values(), default=0) // FILE + 1
    dynamic(x.repartition("period", F.pmod(F.xxhash64(by), F.lit(files))).sortWithinPartitions("period", by)).parquet(f"{path}/rows")
    stored = x.sparkSession.read.parquet(f"{path}/rows").withColumn("period", F.col("period").cast("string")).filter(F.col("period").isin(periods))
    facts = stored.groupBy("period").agg(F.count("*").alias("rows"), F.min(time).alias("first"), F.max(time).alias("last"), F.max(score).alias("best"))
    dynamic(facts.coalesce(1)).parquet(f"{path}/periods")
    bit = stored.select("period", F.explode(_bits(by)).alias("bit"))
    maps = bit.groupBy("period", F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    dynamic(maps).parquet(f"{path}/objects")


class History:
    """A written history; ``read`` gets the names of the periods whose rows a search has read."""

    def __init__(self, spark: SparkSession, path: str, by: str, time: str, score: str):
        self.spark, self.path, self.by, self.time, self.score = spark, path, by, time, score
        text = lambda name: spark.read.parquet(f"{path}/{name}").withColumn("period", F.col("period").cast("string"))
        self.rows, self.objects = text("rows"), text("objects")
        self.periods = {r["period"]: r for r in text("periods").collect()}  # one row for each period
        self.read: list[str] = []

    def steps(self, least: float, newest: bool) -> Iterator[list[str]]:
        """The periods with scores that count, in order, as many at a time as a step looks through."""
        order = sorted((p for p, r in self.periods.items() if r["best"] is not None and r["best"] >= least), reverse=newest)
        k, n = 0, 1
        while k < len(order):
            yield order[k : k + n]
            k, n = k + n, min(2 * n, BATCH)

    def may_hold(self, ids: DataFrame, periods: list[str]) -> DataFrame:
        """(period, object) for objects of ``ids`` all of whose bits the filter of a period has; ``BATCH`` periods at most."""
        # kept ids are a few small files, which alone would make one or two tasks
        own = ids.repartition(self.spark.sparkContext.defaultParallelism, self.by)
        bit = own.select(self.by, F.explode(_bits(self.by)).alias("bit"))
        bit = bit.select(self.by, F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("at"))
        maps = F.broadcast(self.objects.filter(F.col("period").isin(periods)).select("period", "bucket", "bits"))
        byte = F.conv(F.hex(F.substring("bits", (F.col("at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = bit.join(maps, "bucket").withColumn("byte", byte).filter(F.expr("shiftright(byte, CAST(at % 8 AS INT)) & 1") == 1)
        return found.groupBy("period", self.by).agg(F.count("*").alias("n")).filter(F.col("n") == HASHES).select("period", self.by)

    def hits(self, ids: DataFrame, periods: list[str], least: float) -> DataFrame | None:
        """The rows of some periods that count for ``ids``, or None where the summaries prove that there are none."""
        likely = sorted(r[0] for r in self.may_hold(ids, periods).select("period").distinct().collect())
        if not likely:
            return None
        self.read += likely
        own = self.rows.filter(F.col("period").isin(likely)).filter(F.col(self.score) >= least)
        return own.join(ids, self.by, "left_semi")

    def last_seen(self, ids: DataFrame, least: float) -> DataFrame:
        """(object, last): when each object of ``ids`` was last seen with a score that counts; objects never seen give no row."""
        left = kept.keep(ids.select(self.by).filter(F.col(self.by).isNotNull()).distinct(), "left")
        out = left.limit(0).select(self.by, F.lit(None).cast(self.rows.schema[self.time].dataType).alias("last"))
        for periods in self.steps(least, newest=True):
            rows = self.hits(left, periods, least)
            if rows is None:
                continue
            found = rows.groupBy(self.by).agg(F.max(self.time).alias("last"))
            both = kept.keep(left.join(found, self.by, "left"), "seen")
            out = out.unionByName(both.filter("last IS NOT NULL"))
            left = both.filter("last IS NULL").select(self.by)
            if left.isEmpty():
                break
        return out

    def earliest_cluster(self, ids: DataFrame, least: float, gap: int, needed: int = 1) -> DataFrame:
        """(object, start, end, frames): each object's earliest scene with ``needed`` hits or more, oldest periods first.

        A scene that can go on in the next step's periods is carried there, and an object is done when its scene has ended.
        """
        by, scene = self.by, ["start", "end", "frames"]
        left = kept.keep(ids.select(by).filter(F.col(by).isNotNull()).distinct(), "left")
        held = out = None
        steps = list(self.steps(least, newest=False))
        for k, periods in enumerate(steps):
            rows = self.hits(left, periods, least)
            if rows is None and held is None:
                continue
            parts = [] if rows is None else [rows.select(by, F.col(self.time).alias("start"), F.col(self.time).alias("end"), F.lit(1).cast("long").alias("frames"))]
            x = parts[0] if held is None else held if not parts else parts[0].unionByName(held)
            w = Window.partitionBy(by).orderBy("start", "end")
            new = F.coalesce(F.col("start") - F.lag("end").over(w) > gap, F.lit(True))
            x = x.withColumn("new", new).withColumn("scene", F.count_if("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
            scenes = kept.keep(x.groupBy(by, "scene").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("frames").alias("frames")), "scenes")
            following = self.periods[steps[k + 1][0]]["first"] if steps[k + 1 :] else None
            over = F.lit(True) if following is None else F.col("end") + gap < following
            first = scenes.filter(F.col("frames") >= needed).groupBy(by).agg(F.min_by(F.struct(*scene), "scene").alias("s")).select(by, "s.*")
            done = kept.keep(first.filter(over), "clusters")
            out = done if out is None else out.unionByName(done)
            left = kept.keep(left.join(done, by, "left_anti"), "left")
            if left.isEmpty():
                break
            open_ = scenes.join(left, by, "left_semi").filter(~over) if following is not None else None
            held = kept.keep(open_.select(by, *scene), "held") if open_ is not None else None
            if held is not None and held.isEmpty():
                held = None
        if out is None:
            kind = self.rows.schema[self.time].dataType.simpleString()
            return self.spark.createDataFrame([], f"{by} {left.schema[by].dataType.simpleString()}, start {kind}, end {kind}, frames long")
        return out
