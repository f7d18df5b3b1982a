"""Exact percentiles of groups of any size, by way of sketches that can be stored and merged.

A KLL sketch of some kilobytes holds the ranks of a group's values to within an error that its size sets. Sketches of days are stored, and
merged for sessions, months or all time. For an exact percentile the merged sketch gives two values between which it must
lie; a second pass counts the values below the first, and sorts only those between. Where the sketch was unlucky, which the counts tell,
the values of that group are sorted whole, as counts of distinct values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Size of a sketch, and the share of a group's ranks on each side of the wanted one that a second pass looks at.
#: A sketch of this size has a rank error of some 0.7 % at 99 % confidence; what it misses is found by the fallback.
SIZE, BAND = 400, 0.015


def sketches(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, n, least, most, sketch) of the non-null whole values of each group: to be stored, and merged later."""
    v = F.col(value).cast("long")
    return df.filter(v.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.min(v).alias("least"), F.max(v).alias("most"), F.kll_sketch_agg_bigint(v, F.lit(SIZE)).alias("sketch"))


def merged(stored: DataFrame, by: list[str]) -> DataFrame:
    """Stored sketches of finer groups as those of ``by``; each task merges its own first."""
    return stored.groupBy(*by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_bigint("sketch").alias("sketch"))


def rank_of(n: Column, p: float, rule: str = "nearest") -> Column:
    """The wanted place, from 1: ceil(p * n), or by the rule "floor" floor(p * (n - 1)) + 1."""
    if rule not in ("nearest", "floor"):
        raise ValueError(rule)
    return F.greatest(F.lit(1), F.ceil(F.lit(p) * n)) if rule == "nearest" else F.floor(F.lit(p) * (n - 1)) + 1


def approximate(sketched: DataFrame, p: float, name: str) -> DataFrame:
    """``sketched`` and ``name``: about the percentile ``p``, from the sketch alone."""
    return sketched.withColumn(name, F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(p))))


def exact(df: DataFrame, sketched: DataFrame, by: str, value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """(by, n, most, and a column for each of ``wanted``): exact percentiles, given as name: (p, rule), of all groups of ``sketched``.

    ``sketched`` holds the sketches of the same rows, one row for each group. The second pass aggregates equal values before they move, and
    what is sorted is the distinct values of a band about each wanted rank, BAND of a group's ranks to either side.
    """
    names = list(wanted)
    q = lambda p: F.kll_sketch_get_quantile_bigint("sketch", F.lit(min(1.0, max(0.0, p))))
    bands = sketched.select(by, "n", "least", "most", *[F.struct(q(wanted[k][0] - BAND).alias("low"), q(wanted[k][0] + BAND).alias("high"), rank_of(F.col("n"), *wanted[k]).alias("rank")).alias(k) for k in names])
    counts = df.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).cast("long").alias("__v")).agg(F.count("*").alias("__n"))
    x = counts.join(bands, by)
    long = x.select(by, "__v", "__n", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"{k}.low").alias("low"), F.col(f"{k}.high").alias("high"), F.col(f"{k}.rank").alias("rank")) for k in names])).alias("w"))
    long = long.select(by, "__v", "__n", "w.*")
    inside = F.col("__v").between(F.col("low"), F.col("high"))
    below = long.groupBy(by, "name").agg(F.coalesce(F.sum(F.when(F.col("__v") < F.col("low"), F.col("__n"))), F.lit(0)).alias("below"), F.sum(F.when(F.col("__v") <= F.col("high"), F.col("__n"))).alias("upto"), F.first("rank").alias("rank"))
    hit = (F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("upto"))
    place = _found(long.filter(inside), below.filter(hit), by)
    missed = below.filter(~F.coalesce(hit, F.lit(False))).withColumn("below", F.lit(0).cast("long"))
    place = place.unionByName(_found(long.join(missed.select(by, "name"), [by, "name"], "left_semi"), missed, by))
    values = place.groupBy(by).agg(*[F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in names])
    return sketched.select(by, "n", "most").join(values, by, "left")


def _found(values: DataFrame, wanted: DataFrame, by: str) -> DataFrame:
    """The value at each wanted rank, given the number of values below those looked at."""
    w = Window.partitionBy(by, "name").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    run = values.select(by, "name", "__v", "__n").withColumn("upto", F.sum("__n").over(w))
    near = run.join(wanted.select(by, "name", F.col("below").alias("b"), F.col("rank").alias("r")), [by, "name"])
    return near.filter(F.col("b") + F.col("upto") >= F.col("r")).groupBy(by, "name").agg(F.min("__v").alias("value"))
