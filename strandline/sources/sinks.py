"""Writing: appends, folds over old state and patches, schema evolution, and the report of a long run."""

from __future__ import annotations

import io
import json
import zipfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators.manifest import insert_if_absent
from strandline.operators.sessions import first_seen_ordinals, latest, ordinals, reportable

REPORT_SCHEMA = "strandline-long-run-report-v1"
# The columns of the report's tables, in their order.
SESSION_COLUMNS = {
    "session_ordinal": "session_ordinal", "profile_id": "profile_id", "requested_width": "requested_width", "requested_height": "requested_height", "quality": "jpeg_quality", "start_offset_ms": "start_offset_ms", "end_offset_ms": "end_offset_ms",
    "recovery_detected": "recovery_detected", "terminal_reason": "terminal_reason", "completion_status": "completion_status", "manufacturer": "manufacturer", "model": "model", "android_release": "android_release", "sdk_int": "sdk_int",
    "build_id": "build_id", "app_version": "app_version", "app_version_code": "app_version_code", "negotiated_width": "negotiated_width", "negotiated_height": "negotiated_height",
}
SAMPLE_VALUES = ["reason", "battery_level", "battery_scale", "battery_percent", "battery_status", "battery_plugged", "battery_temperature_tenths_c", "charge_counter_uah", "current_now_ua", "current_average_ua", "energy_counter_nwh", "thermal_status", "public_free_bytes", "private_free_bytes"]
CAPTURE_OFFSETS = {"request_offset_ms": "request_elapsed_ms", "scheduled_due_offset_ms": "scheduled_due_elapsed_ms", "prepare_complete_offset_ms": "prepare_complete_elapsed_ms", "camera_invoke_ready_offset_ms": "camera_invoke_ready_elapsed_ms", "camera_terminal_offset_ms": "camera_terminal_elapsed_ms", "disk_drained_offset_ms": "disk_drained_elapsed_ms", "commit_complete_offset_ms": "commit_complete_elapsed_ms"}


def append(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def append_batch(tables: dict[str, DataFrame], folder: str, epoch: int) -> None:
    """Several tables under one epoch id; repeating an epoch replaces what it wrote before."""
    for name, df in tables.items():
        df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(f"{folder}/{name}.parquet")


def append_absent(df: DataFrame, path: str, keys: list[str]) -> None:
    append(insert_if_absent(df, df.sparkSession.read.parquet(path), keys), path)


def publish(df: DataFrame, path: str) -> None:
    """Fails if there is anything at the path; the commit of the job makes the folder appear whole."""
    df.write.mode("errorifexists").parquet(path)


def folded(old: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the non-null values of ``patch`` (a row for each key) in place."""
    values = [c for c in patch.columns if c not in keys]
    p = patch.select(*keys, *[F.col(c).alias(f"__{c}") for c in values])
    x = old.join(p, keys, "left")
    return x.select(*[F.coalesce(f"__{c}", c).alias(c) if c in values else F.col(c) for c in old.columns])


def update_one(old: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """As ``folded``, but every key of ``patch`` must name exactly one row of ``old``."""
    n = old.join(patch.select(*keys), keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("n"))
    wrong = patch.select(*keys).groupBy(*keys).agg(F.count("*").alias("p")).join(n, keys, "left").filter("p <> 1 OR n IS NULL OR n <> 1").limit(1).collect()
    if wrong:
        raise ValueError(f"not exactly one row: {wrong[0].asDict()}")
    return folded(old, patch, keys)


def delete(df: DataFrame, condition: Column) -> DataFrame:
    """Rows that stay; those for which the condition is null stay too."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def revoke(devices: DataFrame, device_id: str) -> DataFrame:
    return devices.withColumn("revoked", F.col("revoked") | (F.col("id") == device_id))


def consume(invitations: DataFrame, used: DataFrame) -> DataFrame:
    """Invitations with those used (invitation_hash) marked."""
    u = used.select(F.col("invitation_hash").alias("token_hash"), F.lit(True).alias("__used")).distinct()
    return invitations.join(u, "token_hash", "left").withColumn("consumed", F.col("consumed") | F.coalesce("__used", F.lit(False))).select(*invitations.columns)


def create_archive(owner: str, archive: str, spark) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([(owner,)], "id string"), spark.createDataFrame([(archive, owner)], "id string, owner_id string")


def evolve(df: DataFrame, target: str, renamed: dict[str, str] | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """``df`` in the schema of a table: columns renamed, missing ones added with a default or null. The source is not touched."""
    from strandline.schemas import schema

    for old, new in (renamed or {}).items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit((defaults or {}).get(f.name)).cast(f.dataType).alias(f.name) for f in schema(target).fields])


def report_sessions(sessions: DataFrame) -> DataFrame:
    """The allow-list of a report: ordinals and offsets, and no id, path, hash or absolute time."""
    start = F.col("start_elapsed_ms")
    x = sessions.withColumns({"session_ordinal": F.lit(1), "start_offset_ms": F.lit(0), "end_offset_ms": scalars.offset(F.col("end_elapsed_ms"), start), "recovery_detected": F.col("recovery_detected_wall_ms").isNotNull()})
    return x.select(F.col("id").alias("session_id"), *[F.col(c).alias(n) for n, c in SESSION_COLUMNS.items()])


def report_samples(samples: DataFrame, sessions: DataFrame) -> DataFrame:
    x = samples.join(sessions.select(F.col("id").alias("session_id"), "start_elapsed_ms"), "session_id")
    x = ordinals(x, "session_id", ["elapsed_ms", "sample_id"], "sample_ordinal")
    return x.select("session_id", "sample_ordinal", scalars.offset(F.col("elapsed_ms"), F.col("start_elapsed_ms")).alias("sample_offset_ms"), *SAMPLE_VALUES)


def report_captures(attempts: DataFrame, sessions: DataFrame) -> DataFrame:
    x = attempts.join(sessions.select(F.col("id").alias("session_id"), "start_elapsed_ms"), "session_id")
    order = ["request_elapsed_ms", "ingest_seq"]
    x = first_seen_ordinals(ordinals(x, "session_id", order, "attempt_ordinal"), "session_id", "frame_id", order, "frame_ordinal")
    at = {n: scalars.offset(F.col(c), F.col("start_elapsed_ms")).alias(n) for n, c in CAPTURE_OFFSETS.items()}
    names = list(at)
    return x.select("session_id", "attempt_ordinal", "frame_ordinal", *[at[n] for n in names[:2]], F.col("requested_interval_ms").alias("effective_interval_ms"), *[at[n] for n in names[2:]], "result", "failure_phase")


def csv_lines(df: DataFrame, without: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """(session_id, line) by the report's CSV rule."""
    columns = [c for c in df.columns if c not in without]
    return df.select("session_id", F.col(columns[0]).alias("ordinal"), scalars.csv_line(*[F.col(c) for c in columns]).alias("line"))


def csv_text(df: DataFrame) -> str:
    """Header and rows of one session's table, in the order of its first column."""
    columns = [c for c in df.columns if c != "session_id"]
    lines = [r["line"] for r in csv_lines(df).orderBy("ordinal").collect()]
    return "\n".join([",".join(columns), *lines]) + "\n"


def manifest_json() -> str:
    return json.dumps({"schema": REPORT_SCHEMA, "session_ordinal": 1, "invocation_scope": "one session that has ended, chosen by whoever asks for the report", "measurement_scope": "battery and temperature values are measured for the whole device", "latency_scope": "pipeline: request to commit; save: drained to commit; neither is shutter time", "timing_scope": "all times are milliseconds since the start of the session"}, separators=(",", ":")) + "\n"


def zip_bytes(entries: dict[str, str]) -> bytes:
    """The same bytes for the same entries: fixed order, times and modes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in entries.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text.encode(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def long_run_report(sessions: DataFrame, samples: DataFrame, attempts: DataFrame, session_id: str) -> bytes | None:
    """The report of one ended session as a ZIP of four entries; None while it is open or unknown.

    A ZIP is one file made in one place: the lines of this one session reach the driver. For all sessions use ``csv_lines``.
    """
    one = reportable(sessions).filter(F.col("id") == session_id)
    if one.isEmpty():
        return None
    own = [d.filter(F.col("session_id") == session_id) for d in (samples, attempts)]
    return zip_bytes({"manifest.json": manifest_json(), "sessions.csv": csv_text(report_sessions(one)), "samples.csv": csv_text(report_samples(own[0], one)), "captures.csv": csv_text(report_captures(own[1], one))})


def last_state(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    return latest(changes, keys, order)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def month_of(time_ms: Column) -> Column:
    """``yyyy-MM`` in UTC."""
    return F.substring(scalars.utc_day(time_ms.cast("long")).cast("string"), 1, 7)


def write_months(df: DataFrame, path: str, time_ms: str) -> None:
    """Partitioned by month, so that recent-first and backward searches read only the months that they need."""
    df.withColumn("year_month", month_of(F.col(time_ms))).repartition("year_month").sortWithinPartitions(time_ms).write.mode("append").partitionBy("year_month").parquet(path)


def replace_months(df: DataFrame, path: str, time_ms: str) -> None:
    """Reprocessing: the months that occur in ``df`` are replaced, and no others."""
    df.withColumn("year_month", month_of(F.col(time_ms))).repartition("year_month").sortWithinPartitions(time_ms).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year_month").parquet(path)


def response_json(df: DataFrame, *columns: str) -> DataFrame:
    """One JSON document a row; null fields stay, as clients look for them."""
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))
