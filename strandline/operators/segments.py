"""Running values of very long sessions: windows that one session spreads over many tasks.

Each session is cut into segments of time. What a segment hands on (its last value, its number of rows) is an aggregate, the few segments
of a session are put in order by a window, and then each segment is a window of its own that begins with what was handed to it.
Results are those of one window over the whole session. A session with so many rows at one time that they do not fit a task
is not cut further. Rows without session or time make one segment each of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import skew
from strandline.operators.motion import score_valid


def _cut(df: DataFrame, time: str, width: int) -> DataFrame:
    return df.withColumn("__segment", F.floor(F.col(time) / F.lit(width)))


def _handed(df: DataFrame, by: str, made: Column, handed: Column) -> DataFrame:
    """(by, segment, __in): ``made`` of each segment, and then ``handed``, a window's value over the segments before."""
    return df.groupBy(by, "__segment").agg(made.alias("__made")).withColumn("__in", handed)


def _with(df: DataFrame, facts: DataFrame, by: str) -> DataFrame:
    f = facts.select(F.col(by).alias("__by"), F.col("__segment").alias("__at"), "__in")
    return df.join(f, df[by].eqNullSafe(F.col("__by")) & df["__segment"].eqNullSafe(F.col("__at")), "left").drop("__by", "__at")


def _before(by: str) -> Window:
    return Window.partitionBy(by).orderBy("__segment").rowsBetween(Window.unboundedPreceding, -1)


def _inside(by: str, order: list[str]) -> Window:
    return Window.partitionBy(by, "__segment").orderBy(*order)


def last_value(df: DataFrame, by: str, time: str, order: list[str], value: Column, width: int, name: str, own: bool = True) -> DataFrame:
    """``df`` and ``name``: the last non-null ``value`` of the session up to the row, or with ``own`` False up to the row before."""
    x = _cut(df.withColumn("__value", value), time, width)
    boxed = F.struct(F.col("__value").alias("v"))
    made = F.max_by(boxed, F.when(F.col("__value").isNotNull(), F.struct(*order)))
    facts = _handed(x, by, made, F.last("__made", ignorenulls=True).over(_before(by)))
    x = _with(x, facts, by)
    w = _inside(by, order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    near = F.last(F.when(F.col("__value").isNotNull(), boxed), ignorenulls=True).over(w)
    return x.withColumn(name, F.coalesce(near, F.col("__in"))["v"]).drop("__value", "__segment", "__in")


def previous(df: DataFrame, by: str, time: str, order: list[str], value: Column, width: int, name: str) -> DataFrame:
    """``df`` and ``name``: ``value`` of the row before, null or not; null for the first row of a session."""
    boxed = last_value(df, by, time, order, F.struct(value.alias("x")), width, "__boxed", own=False)
    return boxed.withColumn(name, F.col("__boxed.x")).drop("__boxed")


def running_count(df: DataFrame, by: str, time: str, order: list[str], counted: Column, width: int, name: str) -> DataFrame:
    """``df`` and ``name``: how many rows of the session up to this one meet ``counted``; with ``lit(True)`` the row's ordinal."""
    x = _cut(df.withColumn("__value", F.coalesce(counted, F.lit(False))), time, width)
    facts = _handed(x, by, F.count_if("__value"), F.coalesce(F.sum("__made").over(_before(by)), F.lit(0)))
    x = _with(x, facts, by)
    w = _inside(by, order).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn(name, F.count_if("__value").over(w) + F.coalesce("__in", F.lit(0))).drop("__value", "__segment", "__in")


def gaps(attempts: DataFrame, width: int, by: str = "session_id", at: str = "request_elapsed_ms", order: str = "ingest_seq") -> DataFrame:
    """``attempts`` and gap_ms to the previous request of the session."""
    x = previous(attempts, by, at, [at, order], F.col(at), width, "__before")
    return x.withColumn("gap_ms", F.col(at) - F.col("__before")).drop("__before")


def ordinals(df: DataFrame, by: str, time: str, order: list[str], width: int, name: str = "ordinal") -> DataFrame:
    return running_count(df, by, time, order, F.lit(True), width, name)


def hysteresis(df: DataFrame, by: str, time: str, order: list[str], signal: Column, width: int, name: str) -> DataFrame:
    """``df`` and ``name``: the last signal (true or false) up to the row, false before the first."""
    x = last_value(df, by, time, order, signal, width, "__signal")
    return x.withColumn(name, F.coalesce("__signal", F.lit(False))).drop("__signal")


def cover_hysteresis(df: DataFrame, by: str, time: str, order: list[str], width: int, mean: str = "mean", variance: str = "variance", enter: tuple[float, float] = (12.0, 25.0), leave: tuple[float, float] = (24.0, 64.0), name: str = "cover_suspected") -> DataFrame:
    """Suspected from mean and variance at or below ``enter``, until either reaches ``leave``."""
    signal = F.when((F.col(mean) <= enter[0]) & (F.col(variance) <= enter[1]), True).when((F.col(mean) >= leave[0]) | (F.col(variance) >= leave[1]), False)
    return hysteresis(df, by, time, order, signal, width, name)


def motion_hysteresis(df: DataFrame, by: str, time: str, order: list[str], width: int, score: str = "score", enter: float = 12.0, leave: float = 5.0, quiet: int = 3000, name: str = "moving", highest: float | None = 255.0) -> DataFrame:
    """Moving from a score of ``enter`` on, until scores have stayed at ``leave`` or less for ``quiet``; see ``motion``.

    A run of low scores has the number of other scores before it; when it began is an aggregate over the run.
    """
    valid = score_valid(F.col(score), highest)
    x = df.withColumn("__valid", valid).withColumn("__low", valid & (F.col(score) <= leave))
    x = running_count(x, by, time, order, F.col("__valid") & ~F.col("__low"), width, "__run")
    began = x.filter("__low").groupBy(by, "__run").agg(F.min(time).alias("__since"))
    x = skew.join_facts(x, began, [by, "__run"], F.col(time))
    signal = F.when(F.col("__valid") & (F.col(score) >= enter), True).when(F.col("__low") & (F.col(time) - F.col("__since") >= quiet), False)
    return hysteresis(x, by, time, order, signal, width, name).drop("__valid", "__low", "__run", "__since")


def latest_within(df: DataFrame, by: str, time: str, order: list[str], value: str, wanted: Column, tolerance: int, width: int, name: str) -> DataFrame:
    """Rows that ask (``wanted``), each with the latest value at or before it, if that is at most ``tolerance`` old."""
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    x = last_value(df, by, time, order, seen, width, "__seen").filter(wanted)
    return x.withColumn(name, F.when(F.col(time) - F.col("__seen.t") <= tolerance, F.col("__seen.v"))).drop("__seen")
