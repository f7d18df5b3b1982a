"""Constraints that Spark does not enforce, as tables of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import schemas
from strandline.functions import scalars as s


def foreign_key(child: DataFrame, columns: list[str], parent: DataFrame, parent_columns: list[str]) -> DataFrame:
    """Rows of ``child`` whose key is given in full but not in ``parent``."""
    keys = parent.select(*[F.col(p).alias(f"__{i}") for i, p in enumerate(parent_columns)]).distinct()
    given = child.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns]))
    return given.join(keys, [F.col(c) == F.col(f"__{i}") for i, c in enumerate(columns)], "left_anti")


def integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """(child, parent, violations) for each foreign key between the tables given."""
    found = [
        foreign_key(tables[c], cc, tables[p], pc).agg(F.count("*").alias("violations")).select(F.lit(c).alias("child"), F.lit(",".join(cc)).alias("columns"), F.lit(p).alias("parent"), "violations")
        for c, cc, p, pc in schemas.FOREIGN_KEYS
        if c in tables and p in tables
    ]
    return reduce(DataFrame.unionByName, found)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def exactly_one(df: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``wanted`` that do not name exactly one row of ``df``, with their number."""
    n = df.join(wanted.select(*keys).distinct(), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("n"))
    return wanted.select(*keys).distinct().join(n, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n")).filter("n <> 1")


def metadata_violations(m: str = "metadata") -> Column:
    """Codes of the bounds that a frame's metadata breaks; an empty array for none."""
    c = lambda name: F.col(f"{m}.{name}")
    p = lambda name: F.col(f"{m}.profile.{name}")
    side = lambda x: x.between(1, s.MAX_SIDE)
    has = F.col(f"{m}.profile").isNotNull()
    rules = {
        "frame_id": s.is_uuid(c("frame_id")),
        "request_wall_ms": c("request_wall_ms").between(0, s.MAX_TIME),
        "sha256": s.is_sha256(c("sha256")),
        "byte_length": c("byte_length").between(1, s.MAX_BYTES),
        "session_id": c("session_id").isNull() | s.is_uuid(c("session_id")),
        "request_elapsed_ms": s.valid_time(c("request_elapsed_ms")),
        "saved_wall_ms": s.valid_time(c("saved_wall_ms")),
        "capture_settings": c("capture_settings").isNull() | s.valid_text(c("capture_settings"), 0, 2048),
        "profile.id": ~has | s.valid_text(p("id"), 1, 64),
        "profile.requested": ~has | (side(p("requested_width")) & side(p("requested_height"))),
        "profile.jpeg_quality": ~has | p("jpeg_quality").between(1, 100),
        "profile.negotiated": ~has | (F.coalesce(side(p("negotiated_width")), F.lit(True)) & F.coalesce(side(p("negotiated_height")), F.lit(True))),
    }
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules.items()]))


def document_violations() -> dict[str, Column]:
    """Conditional rules of answers: a receipt is null if and only if the state is pending; retryable follows from the code."""
    retry = F.create_map(*[F.lit(x) for code, _, r in schemas.ERRORS for x in (code, r)])
    return {
        "receipt": (F.col("state") == "pending") == F.col("receipt").isNull(),
        "retryable": F.coalesce(F.col("retryable") == retry[F.col("code")], F.lit(False)),
    }


def enum_violations(df: DataFrame, table: str) -> DataFrame:
    """(column, value, n) of values outside the closed sets of a table."""
    found = [df.filter(~F.col(c).isin(allowed)).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("column"), "value", "n") for (t, c), allowed in schemas.ENUMS.items() if t == table]
    return reduce(DataFrame.unionByName, found)


def timestamps_valid(x: Column) -> Column:
    """RFC 3339 in UTC that names a day which exists."""
    return x.rlike("^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}(\\.\\d{1,9})?Z$") & F.try_to_timestamp(x).isNotNull()


def snapshot_parity(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(name, status) of files (name, content) whose content is missing on a side or differs."""
    a, b = [d.select("name", F.sha2("content", 256).alias(h)) for d, h in ((ours, "a"), (theirs, "b"))]
    status = F.when(F.col("a").isNull(), "missing_here").when(F.col("b").isNull(), "missing_there").when(F.col("a") != F.col("b"), "differs")
    return a.join(b, "name", "full_outer").select("name", status.alias("status")).filter("status IS NOT NULL")
