"""Session analytics: per-session diagnostics, ordinals, latest rows, state folds and recovery.

All sessions at once: each table is aggregated by session, and the results are joined to the sessions from the left, so
that sessions without rows stay. Percentiles are nearest-rank (``percentile_disc``), never interpolated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.schemas import ENDINGS

DISCHARGING = 3  # Fixed value of the battery status
PHASES = ["request_elapsed_ms", "prepare_complete_elapsed_ms", "camera_invoke_ready_elapsed_ms", "camera_terminal_elapsed_ms", "disk_drained_elapsed_ms", "commit_complete_elapsed_ms"]


def nearest_rank(name: str, p: float) -> Column:
    """Element ceil(p * n) of the sorted values of a column; null for none."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{name}`)")


def distribution(name: str) -> Column:
    """struct(p50, p95, max) of the non-null whole milliseconds of a column (below 2**53); null for none."""
    return F.when(F.count(name) > 0, F.struct(nearest_rank(name, 0.5).cast("long").alias("p50"), nearest_rank(name, 0.95).cast("long").alias("p95"), F.max(name).alias("max")))


def floor_ranks(df: DataFrame, by: str, value: str, p: float = 0.95, name: str = "floor_rank") -> DataFrame:
    """For each group element floor(p * (n - 1)), counted from 0, of its sorted values: a second definition of a
    percentile, kept apart from the first. Null where all values are null.

    Equal values are counted before they move, and only running totals of distinct values are looked at.
    """
    n = df.groupBy(by, F.col(value).alias("__v")).agg(F.count(value).alias("__n"))
    w = Window.partitionBy(by)
    x = n.withColumn("__upto", F.sum("__n").over(w.orderBy("__v"))).withColumn("__all", F.sum("__n").over(w))
    wanted = F.floor(F.lit(p) * (F.col("__all") - 1))
    return x.groupBy(by).agg(F.min(F.when(F.col("__upto") > wanted, F.col("__v"))).alias(name))


def gaps(attempts: DataFrame, by: str = "session_id", at: str = "request_elapsed_ms", order: str = "ingest_seq") -> DataFrame:
    """``attempts`` and gap_ms to the previous request of the session."""
    w = Window.partitionBy(by).orderBy(at, order)
    return attempts.withColumn("gap_ms", F.col(at) - F.lag(at).over(w))


def _not_negative(x: Column) -> Column:
    return F.when(x >= 0, x)


def attempt_facts(attempts: DataFrame) -> DataFrame:
    """One row for each session with attempts: counts by result, gaps, overruns and latencies."""
    late = F.when(F.col("request_elapsed_ms") > F.col("scheduled_due_elapsed_ms"), F.col("request_elapsed_ms") - F.col("scheduled_due_elapsed_ms"))
    x = gaps(attempts).withColumn("late_ms", late)
    x = x.withColumn("pipeline_ms", _not_negative(F.col("commit_complete_elapsed_ms") - F.col("request_elapsed_ms")))
    x = x.withColumn("save_ms", F.when(F.col("result") == "SAVED", _not_negative(F.col("commit_complete_elapsed_ms") - F.col("disk_drained_elapsed_ms"))))
    by_result = [F.count_if(F.col("result") == r).alias(n) for r, n in (("SAVED", "saved"), ("CAMERA_FAILURE", "camera_failures"), ("STORAGE_FAILURE", "storage_failures"), ("INTERRUPTED", "interrupted"))]
    return x.groupBy("session_id").agg(
        F.count("*").alias("attempts"), *by_result, distribution("gap_ms").alias("gap"), F.count("late_ms").alias("overruns"), F.max("late_ms").alias("max_overrun_ms"),
        distribution("pipeline_ms").alias("pipeline"), distribution("save_ms").alias("save"),
    )


def sample_facts(samples: DataFrame) -> DataFrame:
    """One row for each session with samples: battery, temperature, thermal state and free storage."""
    valid = scalars.battery_consistent(F.col("battery_level"), F.col("battery_scale"), F.col("battery_percent"))
    x = samples.withColumn("valid", valid).withColumn("at", F.struct("elapsed_ms", "sample_id"))
    facts = F.struct("battery_percent", "battery_scale", "valid", "public_free_bytes", "private_free_bytes")
    start, end = F.col("reason") == "START", F.col("reason") == "END"
    one = x.groupBy("session_id").agg(
        F.count("*").alias("samples"), F.max("at").alias("last"),
        F.min_by(F.when(start, facts), F.when(start, F.col("at"))).alias("start"), F.max_by(F.when(end, facts), F.when(end, F.col("at"))).alias("end"),
        F.bool_and(F.coalesce(F.col("valid") & (F.col("battery_plugged") == 0) & (F.col("battery_status") == DISCHARGING), F.lit(False))).alias("steady"),
        F.min("battery_scale").alias("least_scale"), F.max("battery_scale").alias("most_scale"),
        F.min("battery_temperature_tenths_c").alias("min_temperature_tenths_c"), F.max("battery_temperature_tenths_c").alias("max_temperature_tenths_c"),
        F.max("thermal_status").alias("max_thermal_status"), F.min("public_free_bytes").alias("public_free_min"), F.min("private_free_bytes").alias("private_free_min"),
    )
    first, last = [F.when(F.col(f"{e}.valid"), F.col(f"{e}.battery_percent")) for e in ("start", "end")]
    comparable = F.col("steady") & (F.col("least_scale") == F.col("most_scale"))
    return one.select(
        "session_id", "samples", F.col("last.elapsed_ms").alias("last_sample_elapsed_ms"), first.alias("battery_start"), last.alias("battery_end"), F.when(comparable, last - first).alias("battery_delta"), "steady",
        "min_temperature_tenths_c", "max_temperature_tenths_c", "max_thermal_status", F.col("start.public_free_bytes").alias("public_free_start"), F.col("end.public_free_bytes").alias("public_free_end"), "public_free_min",
        F.col("start.private_free_bytes").alias("private_free_start"), F.col("end.private_free_bytes").alias("private_free_end"), "private_free_min",
    )


def size_histogram(df: DataFrame, by: list[str], width: str, height: str, name: str = "actual_sizes") -> DataFrame:
    """``WxH (n), ...`` in the order of width and height."""
    n = df.filter(F.col(width).isNotNull() & F.col(height).isNotNull()).groupBy(*by, width, height).agg(F.count("*").alias("n"))
    sizes = F.array_sort(F.collect_list(F.struct(F.col(width).alias("w"), F.col(height).alias("h"), "n")))
    return n.groupBy(*by).agg(F.array_join(F.transform(sizes, lambda s: F.format_string("%dx%d (%d)", s["w"], s["h"], s["n"])), ", ").alias(name))


def frame_facts(frames: DataFrame) -> DataFrame:
    """Committed frames of each session: number, bytes, and sizes."""
    done = frames.filter("state = 1 AND session_id IS NOT NULL")
    return done.groupBy("session_id").agg(F.count("*").alias("frames"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("frame_bytes")).join(size_histogram(done, ["session_id"], "actual_width", "actual_height"), "session_id", "left")


def session_diagnostics(sessions: DataFrame, samples: DataFrame, attempts: DataFrame, frames: DataFrame, now_elapsed_ms: int) -> DataFrame:
    """One row for each session. An interrupted session has no duration and no sample age, whatever the clock says."""
    x = sessions.withColumnRenamed("id", "session_id")
    for facts in (attempt_facts(attempts), sample_facts(samples), frame_facts(frames)):
        x = x.join(facts, "session_id", "left")
    reference = F.when(F.col("completion_status") == "OPEN", F.lit(now_elapsed_ms)).otherwise(F.col("end_elapsed_ms"))
    until = F.when(F.col("end_elapsed_ms").isNotNull(), F.col("end_elapsed_ms")).when(F.col("completion_status") == "OPEN", F.lit(now_elapsed_ms))
    x = x.withColumn("duration_ms", _not_negative(until - F.col("start_elapsed_ms"))).withColumn("sample_age_ms", _not_negative(reference - F.col("last_sample_elapsed_ms")))
    zero = ["attempts", "saved", "camera_failures", "storage_failures", "interrupted", "overruns", "samples", "frames", "frame_bytes"]
    return x.fillna(0, zero).fillna("unknown", ["actual_sizes"])


def latest(df: DataFrame, by: list[str], order: str = "ingest_seq") -> DataFrame:
    """The row of each group that was inserted last; wall clocks can go backwards, the insertion order cannot.

    Rows without an order are not looked at. One row a group and task is shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.filter(F.col(order).isNotNull()).groupBy(*by).agg(F.max_by(row, F.col(order)).alias("__r")).select("__r.*")


def select_session(sessions: DataFrame, preferred: str | None = None) -> DataFrame:
    """The preferred session, or the one inserted last."""
    if preferred is not None:
        return sessions.filter(F.col("id") == preferred)
    return sessions.orderBy(F.col("ingest_seq").desc()).limit(1)


def ordinals(df: DataFrame, by: str, order: list[str], name: str = "ordinal") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def first_seen_ordinals(df: DataFrame, by: str, key: str, order: list[str], name: str = "key_ordinal") -> DataFrame:
    """Dense number of each key in the order of its first row in the group; null for a null key."""
    x = df.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    x = x.withColumn("__first", F.when(F.col(key).isNotNull(), F.min("__n").over(Window.partitionBy(by, key))))
    dense = F.dense_rank().over(Window.partitionBy(by, F.col(key).isNull()).orderBy("__first"))
    return x.withColumn(name, F.when(F.col(key).isNotNull(), dense)).drop("__n", "__first")


def archive_summary(frames: DataFrame, sessions: DataFrame, session_id: str | None = None) -> DataFrame:
    """One row: committed and quarantined frames, the committed frame inserted last, and the frames of a session (the latest by default)."""
    last = F.max_by(F.struct("saved_wall_ms", "uri", "relative_path", "bytes", "actual_width", "actual_height", "availability", "profile_id"), F.when(F.col("state") == 1, F.col("ingest_seq")))
    totals = frames.agg(F.count_if(F.col("state") == 1).alias("frames"), F.count_if(F.col("state") == 2).alias("quarantined"), last.alias("latest"))
    chosen = select_session(sessions, session_id).select("id")
    own = frames.filter("state = 1").join(F.broadcast(chosen), F.col("session_id") == chosen["id"], "left_semi").agg(F.count("*").alias("session_frames"))  # one row
    return totals.crossJoin(own)  # one row by one row


def visible_frames(frames: DataFrame) -> DataFrame:
    return frames.filter("state = 1 AND validated = 1 AND availability = 'AVAILABLE'")


def phase_order(columns: list[str] = PHASES) -> Column:
    """Whether the phases that were reached came in order; phases that were not reached do not count."""
    reached = F.array_compact(F.array(*columns))
    return reached == F.array_sort(reached)


def with_existing(attempts: DataFrame, frames: DataFrame) -> DataFrame:
    """``attempts`` and frame_committed: whether its frame is committed."""
    done = frames.filter("state = 1").select(F.col("id").alias("__frame")).distinct()
    return attempts.join(done, F.col("frame_id") == F.col("__frame"), "left").withColumn("frame_committed", F.col("__frame").isNotNull()).drop("__frame")


def recover_attempts(attempts: DataFrame, frames: DataFrame) -> DataFrame:
    """Attempts left pending by a crash: saved if their frame is committed, else interrupted; the commit time is unknown."""
    x = with_existing(attempts, frames)
    open_ = F.col("result") == "PENDING"
    result = F.when(open_, F.when(F.col("frame_committed"), "SAVED").otherwise("INTERRUPTED")).otherwise(F.col("result"))
    phase = F.when(open_, F.when(F.col("frame_committed"), "RECOVERY_FRAME_COMMITTED").otherwise("PROCESS_INTERRUPTED")).otherwise(F.col("failure_phase"))
    commit = F.when(~open_, F.col("commit_complete_elapsed_ms"))
    return x.withColumns({"commit_complete_elapsed_ms": commit, "failure_phase": phase, "result": result}).drop("frame_committed")


def recover_sessions(sessions: DataFrame, detected_wall_ms: int) -> DataFrame:
    """Sessions left open by a crash become interrupted, without an end."""
    was_open = F.col("completion_status") == "OPEN"
    null = F.lit(None).cast("long")
    return sessions.withColumns(
        {
            "end_wall_ms": F.when(was_open, null).otherwise(F.col("end_wall_ms")),
            "end_elapsed_ms": F.when(was_open, null).otherwise(F.col("end_elapsed_ms")),
            "recovery_detected_wall_ms": F.when(was_open, F.lit(detected_wall_ms)).otherwise(F.col("recovery_detected_wall_ms")),
            "terminal_reason": F.when(was_open, F.lit("PROCESS_INTERRUPTED")).otherwise(F.col("terminal_reason")),
            "completion_status": F.when(was_open, F.lit("INTERRUPTED")).otherwise(F.col("completion_status")),
        }
    )


def attempts_from_events(events: DataFrame) -> DataFrame:
    """Attempts folded from phase events (attempt_id, session_id, phase, elapsed_ms, result, failure_phase, ingest_seq).

    The first value of a phase counts, and so does the first result other than PENDING: a transition happens once.
    """
    phases = [F.min_by(F.when(F.col("phase") == p, F.col("elapsed_ms")), F.when(F.col("phase") == p, F.col("ingest_seq"))).alias(p) for p in PHASES]
    end = F.when(F.col("result").isNotNull() & (F.col("result") != "PENDING"), F.col("ingest_seq"))
    out = events.groupBy("session_id", "attempt_id").agg(*phases, F.min_by("result", end).alias("result"), F.min_by("failure_phase", end).alias("failure_phase"), F.min("ingest_seq").alias("ingest_seq"))
    return out.withColumn("result", F.coalesce("result", F.lit("PENDING"))).withColumn("phases_in_order", phase_order())


def sessions_from_events(events: DataFrame) -> DataFrame:
    """Sessions folded from (session_id, kind start or end, elapsed_ms, wall_ms, ending, ingest_seq): the last end wins over none."""
    start, end = F.col("kind") == "start", F.col("kind") == "end"
    reasons = F.create_map(*[F.lit(x) for e in ENDINGS for x in (e[0], e[1])])
    statuses = F.create_map(*[F.lit(x) for e in ENDINGS for x in (e[0], e[2])])
    one = events.groupBy("session_id").agg(
        F.min_by("elapsed_ms", F.when(start, F.col("ingest_seq"))).alias("start_elapsed_ms"), F.max_by("elapsed_ms", F.when(end, F.col("ingest_seq"))).alias("end_elapsed_ms"),
        F.max_by("ending", F.when(end, F.col("ingest_seq"))).alias("ending"), F.max(end).alias("ended"), F.min("ingest_seq").alias("ingest_seq"),
    )
    return one.withColumn("terminal_reason", F.when(F.col("ended"), F.coalesce(reasons[F.col("ending")], F.lit("RECORDER_FAILURE")))).withColumn("completion_status", F.when(F.col("ended"), F.coalesce(statuses[F.col("ending")], F.lit("FAILED"))).otherwise("OPEN")).drop("ended", "ending")


def reportable(sessions: DataFrame) -> DataFrame:
    return sessions.filter("completion_status <> 'OPEN'")


def daily_facts(frames: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """For each day of saving, in UTC: frames, bytes, time range, distinct contents, and a checksum of all contents (an extension).

    The checksum is the sum of the first 60 bits of the contents' hashes, so it does not depend on the order of frames.
    With ``jobs`` (frame_id, state) also synced: whether each frame of the day has a job that is done.
    """
    x = frames.filter("state = 1").withColumn("__part", F.conv(F.substring("sha256", 1, 15), 16, 10).cast("decimal(38,0)"))
    more = []
    if jobs is not None:
        done = jobs.groupBy(F.col("frame_id").alias("__frame")).agg(F.bool_or(F.col("state") == "done").alias("__done"))
        x = x.join(done, F.col("id") == F.col("__frame"), "left")
        more = [F.bool_and(F.coalesce("__done", F.lit(False))).alias("synced")]
    day = scalars.utc_day(F.col("saved_wall_ms").cast("long"))
    return x.groupBy(day.alias("day")).agg(
        F.count("*").alias("frames"), F.sum("bytes").alias("bytes"), F.min("saved_wall_ms").alias("first_ms"), F.max("saved_wall_ms").alias("last_ms"),
        F.count_distinct("sha256").alias("contents"), F.sum("__part").cast("string").alias("checksum"), *more,
    )


def coverage(blocks: DataFrame) -> DataFrame:
    """Share of statements in blocks (statements, hits) that ran."""
    return blocks.agg((F.sum(F.when(F.col("hits") > 0, F.col("statements")).otherwise(0)) / F.sum("statements")).alias("coverage"))
