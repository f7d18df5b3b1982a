import zipfile
from io import BytesIO

from pyspark.sql import functions as F

from strandline import schemas
from strandline.operators import sessions
from strandline.sources import readers, sinks


def frame(spark, table, rows):
    fields = schemas.schema(table)
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], fields)


def session(**more):
    base = dict(id="s", journal_version=2, profile_id="p", requested_width=16, requested_height=12, jpeg_quality=90, requested_settings="x", start_wall_ms=1, start_elapsed_ms=900, completion_status="COMPLETE", end_elapsed_ms=8000, manufacturer="m", model="m", android_release="1", sdk_int=1, build_id="b", app_version="1", app_version_code=1, ingest_seq=1)
    return base | more


def golden(spark):
    at, due = [1000, 2000, 5000, 7000], [1000, 2000, 4000, 7000]
    attempts = [dict(attempt_id=str(k), session_id="s", frame_id=f"f{k}", request_wall_ms=0, request_elapsed_ms=t, scheduled_due_elapsed_ms=due[k], requested_interval_ms=2000, disk_drained_elapsed_ms=t + 40, commit_complete_elapsed_ms=t + 100 * (k + 1), result="SAVED", ingest_seq=k) for k, t in enumerate(at)]
    samples = [
        dict(sample_id=k, session_id="s", wall_ms=0, elapsed_ms=1000 + 1000 * k, reason=r, battery_level=level, battery_scale=100, battery_percent=float(level), battery_status=3, battery_plugged=0, battery_temperature_tenths_c=t, thermal_status=th, public_free_bytes=pub, private_free_bytes=prv)
        for k, (r, level, t, th, pub, prv) in enumerate([("START", 80, 310, 0, 1000, 900), ("PERIODIC", 79, 350, 3, 800, 700), ("END", 78, 330, 2, 900, 600)])
    ]
    frames = [dict(id=f"f{k}", state=1, session_id="s", bytes=10, actual_width=16, actual_height=12, ingest_seq=k, validated=1, availability="AVAILABLE", uri=f"u{k}") for k in range(4)]
    return samples, attempts, frames


def diagnose(spark, sess, samples, attempts, frames, now=9000):
    return sessions.session_diagnostics(frame(spark, "capture_sessions", sess), frame(spark, "telemetry_samples", samples), frame(spark, "capture_attempts", attempts), frame(spark, "device_frames", frames), now)


def test_golden_diagnostics(spark):
    r = diagnose(spark, [session()], *golden(spark)).first()
    assert tuple(r.gap) == (2000, 3000, 3000)
    assert (r.overruns, r.max_overrun_ms) == (1, 1000)
    assert tuple(r.pipeline) == (200, 400, 400) and tuple(r.save) == (160, 360, 360)
    assert (r.attempts, r.saved, r.frames, r.frame_bytes, r.samples) == (4, 4, 4, 40, 3)
    assert (r.battery_start, r.battery_end, r.battery_delta) == (80, 78, -2)
    assert (r.min_temperature_tenths_c, r.max_temperature_tenths_c, r.max_thermal_status) == (310, 350, 3)
    assert (r.public_free_start, r.public_free_end, r.public_free_min) == (1000, 900, 800)
    assert (r.private_free_start, r.private_free_end, r.private_free_min) == (900, 600, 600)
    assert r.actual_sizes == "16x12 (4)" and r.duration_ms == 7100 and r.sample_age_ms == 5000


def test_battery_regimes(spark):
    samples, attempts, frames = golden(spark)
    samples[1]["battery_plugged"] = 1
    r = diagnose(spark, [session()], samples, attempts, frames).first()
    assert (r.battery_start, r.battery_end, r.battery_delta) == (80, 78, None)
    for s in samples:
        s["battery_level"] = s["battery_percent"] = None
    r = diagnose(spark, [session()], samples, attempts, frames).first()
    assert (r.battery_start, r.battery_end, r.battery_delta) == (None, None, None)


def test_session_without_rows_and_interrupted(spark):
    r = diagnose(spark, [session(end_elapsed_ms=None, completion_status="INTERRUPTED")], [], [], []).first()
    assert (r.duration_ms, r.sample_age_ms, r.gap, r.attempts, r.actual_sizes) == (None, None, None, 0, "unknown")
    r = diagnose(spark, [session(end_elapsed_ms=None, completion_status="OPEN")], golden(spark)[0], [], []).first()
    assert (r.duration_ms, r.sample_age_ms) == (8100, 6000)


def test_nearest_rank_and_floor_rank(spark):
    import math

    for n in (1, 2, 3, 19, 20, 21, 100):
        df = spark.range(n).withColumn("x", F.col("id") * 10)
        r = df.agg(sessions.distribution("x").alias("d")).crossJoin(sessions.floor_ranks(df.withColumn("g", F.lit(1)), "g", "x", name="f")).first()
        assert r.d.p50 == 10 * (math.ceil(0.5 * n) - 1) and r.d.p95 == 10 * (math.ceil(0.95 * n) - 1) and r.f == 10 * math.floor(0.95 * (n - 1))


def test_recovery(spark):
    _, attempts, frames = golden(spark)
    for a in attempts:
        a["result"] = "PENDING"
    frames[1]["state"] = 0
    out = {r.attempt_id: r for r in sessions.recover_attempts(frame(spark, "capture_attempts", attempts), frame(spark, "device_frames", frames)).collect()}
    assert (out["0"].result, out["0"].failure_phase, out["0"].commit_complete_elapsed_ms) == ("SAVED", "RECOVERY_FRAME_COMMITTED", None)
    assert (out["1"].result, out["1"].failure_phase) == ("INTERRUPTED", "PROCESS_INTERRUPTED")
    s = sessions.recover_sessions(frame(spark, "capture_sessions", [session(completion_status="OPEN")]), 77).first()
    assert (s.completion_status, s.terminal_reason, s.end_elapsed_ms, s.recovery_detected_wall_ms) == ("INTERRUPTED", "PROCESS_INTERRUPTED", None, 77)


def test_latest_ignores_wall_clock(spark):
    df = spark.createDataFrame([("a", 1, 900), ("a", 2, 100)], "g string, ingest_seq long, wall long")
    assert sessions.latest(df, ["g"]).first().wall == 100


def test_folds_from_events(spark):
    e = spark.createDataFrame([("s", "a", "request_elapsed_ms", 10, "PENDING", None, 1), ("s", "a", "prepare_complete_elapsed_ms", 12, None, None, 2), ("s", "a", "commit_complete_elapsed_ms", 11, "SAVED", None, 3), ("s", "a", "commit_complete_elapsed_ms", 99, "INTERRUPTED", "late", 4)], "session_id string, attempt_id string, phase string, elapsed_ms long, result string, failure_phase string, ingest_seq long")
    r = sessions.attempts_from_events(e).first()
    assert (r.result, r.commit_complete_elapsed_ms, r.phases_in_order) == ("SAVED", 11, False)
    e = spark.createDataFrame([("a", "start", 5, 0, None, 1), ("a", "end", 9, 0, "timeout", 2), ("b", "start", 1, 0, None, 3), ("c", "start", 1, 0, None, 4), ("c", "end", 2, 0, "odd", 5)], "session_id string, kind string, elapsed_ms long, wall_ms long, ending string, ingest_seq long")
    got = {r.session_id: (r.terminal_reason, r.completion_status, r.end_elapsed_ms) for r in sessions.sessions_from_events(e).collect()}
    assert got == {"a": ("CAPTURE_TIMEOUT", "FAILED", 9), "b": (None, "OPEN", None), "c": ("RECORDER_FAILURE", "FAILED", 2)}


def test_report_is_repeatable_and_keeps_secrets(spark):
    samples, attempts, frames = golden(spark)
    secret = session(id="secret-id", start_wall_ms=123456789, model='Model,"quoted"\nline')
    for r in samples + attempts:
        r["session_id"] = "secret-id"
    tables = frame(spark, "capture_sessions", [secret]), frame(spark, "telemetry_samples", samples), frame(spark, "capture_attempts", attempts)
    one, two = sinks.long_run_report(*tables, "secret-id"), sinks.long_run_report(*tables, "secret-id")
    assert one == two
    z = zipfile.ZipFile(BytesIO(one))
    assert z.namelist() == ["manifest.json", "sessions.csv", "samples.csv", "captures.csv"]
    text = b"".join(z.read(n) for n in z.namelist()).decode()
    assert "secret-id" not in text and "123456789" not in text and "f0" not in text
    assert '"Model,""quoted""\nline"' in text
    assert z.read("captures.csv").decode().splitlines()[1].startswith("1,1,100,100,2000,,,,140,200,SAVED")
    assert sinks.long_run_report(frame(spark, "capture_sessions", [session(completion_status="OPEN")]), tables[1], tables[2], "s") is None


def test_summary_visible_and_lookup(spark):
    _, attempts, frames = golden(spark)
    frames[3]["state"] = 2
    f, s = frame(spark, "device_frames", frames), frame(spark, "capture_sessions", [session()])
    r = sessions.archive_summary(f, s).first()
    assert (r.frames, r.quarantined, r.latest.uri, r.session_frames) == (3, 1, "u2", 3)
    assert sessions.visible_frames(f).count() == 3
    a = frame(spark, "capture_attempts", attempts)
    assert readers.attempt_value(a, "1", "result") == "SAVED" and readers.attempt_value(a, "1", "failure_phase") is None
    import pytest

    with pytest.raises(readers.NotFound):
        readers.attempt_value(a, "9", "result")
    with pytest.raises(ValueError):
        readers.attempt_value(a, "1", "attempt_id; --")
    assert [r.attempt_id for r in readers.session_attempts(a, "s").collect()] == ["0", "1", "2", "3"]


def test_daily_and_coverage(spark):
    f = frame(spark, "device_frames", [dict(id="a", state=1, bytes=5, saved_wall_ms=86_400_000, sha256="x"), dict(id="b", state=1, bytes=6, saved_wall_ms=86_400_001, sha256="x")])
    r = sessions.daily_facts(f).first()
    assert (str(r.day), r.frames, r.bytes, r.contents) == ("1970-01-02", 2, 11, 1)
    assert sessions.coverage(spark.createDataFrame([(3, 1), (1, 0)], "statements long, hits long")).first()[0] == 0.75
