from pyspark.sql import functions as F

from strandline.operators import motion
from strandline.streaming import stateful


def _run(df, path, out):
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_schedule_survives_a_restart(spark, tmp_path):
    rows = [("s", t, 20.0 if 1000 < t < 1300 else 0.0) for t in range(0, 12_001, 100)] + [("r", t, 0.0) for t in range(0, 12_001, 700)]
    df = spark.createDataFrame(rows, "session_id string, t_ms long, score double")
    want = sorted((r.session_id, r.t_ms, r.due_ms) for r in motion.capture_schedule(df).filter("accepted").collect())
    src, out, check = [str(tmp_path / x) for x in ("in", "out", "check")]
    for low, high in ((0, 5000), (5000, 99_999)):  # a second query picks up the state of the first
        df.filter((F.col("t_ms") >= low) & (F.col("t_ms") < high)).coalesce(1).write.mode("append").parquet(src)
        _run(stateful.schedule_stream(spark.readStream.schema(df.schema).parquet(src)), check, out)
    assert sorted((r.session_id, r.t_ms, r.due_ms) for r in spark.read.parquet(out).collect()) == want


def test_coalescer_golden(spark, tmp_path):
    busy, waiting, got = stateful.coalesce(False, None, stateful.Request("PERIODIC"))
    assert got == ("PERIODIC", None)
    for level in (2, 5, 3):
        busy, waiting, got = stateful.coalesce(busy, waiting, stateful.Request("THERMAL_CHANGE", level))
        assert got is None
    busy, waiting, got = stateful.coalesce(busy, waiting, stateful.Request("PERIODIC"))
    assert got is None
    busy, waiting, got = stateful.coalesce(busy, waiting, None)
    assert got == ("THERMAL_CHANGE", 5)
    busy, waiting, got = stateful.coalesce(busy, waiting, None)
    assert got is None and not busy
    assert stateful.coalesce(False, None, None) == (False, None, None)
    assert stateful.coalesce(True, stateful.Request("PERIODIC"), stateful.Request("END"))[1] == ("END", None)  # the newest
    rows = [("s", 1, "offer", "PERIODIC", None), ("s", 2, "offer", "THERMAL_CHANGE", 2), ("s", 3, "offer", "THERMAL_CHANGE", 5), ("s", 4, "offer", "THERMAL_CHANGE", 3), ("s", 5, "complete", None, None)]
    df = spark.createDataFrame(rows, "session_id string, ingest_seq long, action string, reason string, thermal long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    _run(stateful.coalesce_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), str(tmp_path / "c"), str(tmp_path / "out"))
    assert [(r.ingest_seq, r.thermal) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ingest_seq").collect()] == [(1, None), (5, 5)]


def test_batch_helpers(spark):
    df = spark.createDataFrame([("s", 1, 10), ("s", 2, 20)], "session_id string, t_ms long, x long")
    assert [r.x for r in stateful.latest_only(df).collect()] == [20]
    samples = spark.createDataFrame([("s", k, t) for k, t in enumerate((10, 59_999, 60_000, 61_000, 185_000))], "session_id string, sample_id long, elapsed_ms long")
    starts = spark.createDataFrame([("s", 0)], "session_id string, start_elapsed_ms long")
    assert sorted(r.elapsed_ms for r in stateful.periodic(samples, starts).collect()) == [60_000, 185_000]


def test_registration_is_idempotent(spark, tmp_path):
    from strandline import schemas

    catalog, src = str(tmp_path / "catalog"), str(tmp_path / "in")
    spark.createDataFrame([], schemas.schema("frames")).write.parquet(catalog)
    m = {"frame_id": "00000000-0000-4000-8000-000000000001", "request_wall_ms": 1, "sha256": "a" * 64, "byte_length": 1}
    batch = spark.createDataFrame([("b1", "a", [m])], f"batch_id string, archive_id string, frames array<{schemas.METADATA}>")
    for k in range(2):
        batch.write.mode("append").parquet(src)
        q = stateful.register_stream(spark.readStream.schema(batch.schema).parquet(src), catalog, str(tmp_path / f"check{k}"))
        q.awaitTermination(120)
    assert spark.read.parquet(catalog).count() == 1


def test_counts_and_windows_on_streams(spark, tmp_path):
    import datetime

    frames = spark.createDataFrame([("s", 1, 10), ("s", 1, 5), ("s", 0, 7), ("r", 1, 1)], "session_id string, state int, bytes long")
    frames.coalesce(1).write.parquet(str(tmp_path / "frames"))
    q = stateful.count_stream(spark.readStream.schema(frames.schema).parquet(str(tmp_path / "frames"))).writeStream.format("memory").queryName("counted").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counted").collect())) == [("r", 1, 1), ("s", 2, 15)]
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    src, schema = str(tmp_path / "events"), "ts timestamp, event_type string"
    out, check = str(tmp_path / "w"), str(tmp_path / "wc")
    for rows in ([(at(1), "a"), (at(4), "a"), (at(30), "b")], [(at(2), "late"), (at(59), "b")], [(at(59), "c")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        _run(stateful.windowed_counts(spark.readStream.schema(schema).parquet(src)), check, out)
    got = sorted((r.window.start.minute, r.event_type, r.n) for r in spark.read.parquet(out).collect())
    assert got == [(0, "a", 2), (30, "b", 1)]  # the row that came after the watermark is not counted


def test_timeout_of_silent_sessions(spark, tmp_path):
    import time

    src = str(tmp_path / "beats")
    rows = spark.createDataFrame([("s", 5), ("s", 9), ("r", 1)], "session_id string, t_ms long")
    rows.coalesce(1).write.parquet(src)
    out = str(tmp_path / "silent")
    q = stateful.timeout_stream(spark.readStream.schema(rows.schema).parquet(src), 500).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if q.lastProgress and sorted(map(tuple, spark.read.schema("session_id string, last_ms long").parquet(out).collect())) == [("r", 1), ("s", 9)]:
                break
        else:
            raise AssertionError("no timeout was told")
    finally:
        q.stop()
