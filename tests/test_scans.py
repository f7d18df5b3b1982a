"""Histories, commits, segments and gapped sequences, each against a plain version."""

import random

import pytest
from pyspark.sql import functions as F

from strandline import kept
from strandline.operators import history, motion, retrieval, segments, sequences, sessions, skew
from strandline.sources import commits
from strandline.streaming.sequences import sequence_stream

DAY = 86_400_000


def sightings(seed=1):
    """Objects of which some are seen always, some long ago only, some never well; scenes that cross the ends of months."""
    rnd = random.Random(seed)
    rows = [(k % 5, rnd.randrange(200) * DAY + rnd.randrange(DAY), rnd.random()) for k in range(600)]
    rows += [(7, 20 * DAY + k * 1000, 0.9) for k in range(5)] + [(8, 31 * DAY - 5000 + k * 2000, 0.95) for k in range(6)] + [(9, 190 * DAY, 0.1), (10, 100 * DAY, None), (11, None, 0.9)]
    rows += [(12, d * DAY + 5, 0.99) for d in range(20, 70)]
    return rows


SEEN = "object long, t long, score double"


def test_searches_read_few_periods(spark):
    df = spark.createDataFrame(sightings(), SEEN)
    path = kept.new_path(spark, "history-test")
    history.write_history(df, path, "object", "t", "score")
    every = df.filter("t IS NOT NULL")
    for ids, least in ([0, 1, 2], 0.5), ([7, 8], 0.5), ([99], 0.0), ([0, 7, 8, 9, 10, 11, 12], 0.9):
        wanted = spark.createDataFrame([(i,) for i in [*ids, ids[0], None]], "object long")
        h = history.History(spark, path, "object", "t", "score")
        got = {r.object: r.last for r in h.last_seen(wanted, least).collect()}
        best = {}
        for o, t, s in sightings():
            if o in ids and t is not None and s is not None and s >= least:
                best[o] = max(t, best.get(o, t))
        assert got == best
        if ids in ([7, 8], [99]):
            assert len(h.read) <= 2  # of 7 months
        elif ids == [0, 1, 2]:
            assert len(h.read) < 4
        for needed, gap in ((3, 3000), (30, DAY)) if len(ids) > 1 and least != 0.5 or ids == [7, 8] else ():
            h = history.History(spark, path, "object", "t", "score")
            got = {tuple(r) for r in h.earliest_cluster(wanted, least, gap, needed).collect()}
            own = every.join(wanted.distinct(), "object", "left_semi")
            assert got == {tuple(r) for r in retrieval.earliest_cluster(own, "object", "t", ["t"], gap, least, needed=needed).collect()}
            assert ids != [7, 8] or len(h.read) <= 3


def test_periods_are_replaced(spark):
    path = kept.new_path(spark, "history-test")
    history.write_history(spark.createDataFrame([(1, 5, 0.5), (2, 40 * DAY, 0.5)], SEEN), path, "object", "t", "score")
    history.write_history(spark.createDataFrame([(3, 41 * DAY, 0.7)], SEEN), path, "object", "t", "score")
    h = history.History(spark, path, "object", "t", "score")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "object long")
    assert {tuple(r) for r in h.last_seen(ids, 0.0).collect()} == {(1, 5), (3, 41 * DAY)} and sorted(h.periods) == ["1970-01", "1970-02"]


def test_jobs_do_not_follow_the_periods(spark):
    """Each day has an object of its own, so all days are read: four times the days take less than twice the jobs."""
    jobs = {"last_seen": [], "earliest_cluster": []}
    for days in (6, 24):
        rows = [(d, d * DAY + k, 0.9) for d in range(days) for k in range(3)]
        path = kept.new_path(spark, "history-test")
        history.write_history(spark.createDataFrame(rows, SEEN), path, "object", "t", "score", history.DAY)
        ids = spark.range(-1, days).withColumnRenamed("id", "object")
        for name, least in ("last_seen", [0.5]), ("earliest_cluster", [0.5, 10, 3]):
            h = history.History(spark, path, "object", "t", "score")
            spark.sparkContext.setJobGroup(f"{name} {days}", name)
            got = {tuple(r) for r in getattr(h, name)(ids, *least).collect()}
            spark.sparkContext.setJobGroup("", "")
            assert got == {(d, d * DAY + 2) if name == "last_seen" else (d, d * DAY, d * DAY + 2, 3) for d in range(days)}
            assert sorted(h.read) == sorted(h.periods) and len(h.read) == days
            jobs[name].append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{name} {days}")))
    assert all(0 < few < many < 2 * few for few, many in jobs.values()), jobs


def test_commits_appear_together_or_not_at_all(spark, monkeypatch):
    root = kept.new_path(spark, "commits-test")
    a = lambda *rows: spark.createDataFrame(list(rows), "id long, v string")
    b = lambda *rows: spark.createDataFrame([(r,) for r in rows], "k long")
    assert commits.commit(spark, root, {"sessions": a((1, "x")), "samples": b(10)}, 1)
    broken = b(20).select(F.raise_error(F.lit("lost")).cast("long").alias("k"))
    with pytest.raises(Exception, match="lost"):  # the first table's files are written, the second's are not
        commits.commit(spark, root, {"sessions": a((2, "y")), "samples": broken}, 2)
    see = lambda name, **k: sorted(tuple(r) for r in commits.read(spark, root, name, **k).collect())
    assert see("sessions") == [(1, "x")] and see("samples") == [(10,)] and commits.committed(spark, root) == {"1"}
    assert commits.commit(spark, root, {"sessions": a((2, "y")), "samples": b(20)}, 2)
    assert not commits.commit(spark, root, {"sessions": a((2, "y")), "samples": b(20)}, 2)  # repeated: nothing changes
    assert see("sessions") == [(1, "x"), (2, "y")] and see("sessions", version=1) == [(1, "x")]
    # an update: the old row goes and the new one comes in one commit; rows that come later are not hidden
    commits.commit(spark, root, {"sessions": a((1, "z"))}, 3, deletes={"sessions": a((1, "")).select("id"), "samples": b(10, None, 77)})
    assert see("sessions") == [(1, "z"), (2, "y")] and see("samples") == [(20,)]
    commits.commit(spark, root, {"samples": b(10)}, 4)
    assert see("samples") == [(10,), (20,)]
    commits.compact(spark, root, "sessions")
    commits.commit(spark, root, {}, 5, deletes={"sessions": a((2, "")).select("id")})
    assert see("sessions") == [(1, "z")] and see("samples") == [(10,), (20,)] and see("sessions", version=2) == [(1, "x"), (2, "y")]
    with pytest.raises(KeyError):
        commits.read(spark, root, "frames")
    # a version that is taken meanwhile: a commit takes the next one, a compaction gives up
    log, first = commits._entries, []

    def late(s, r):
        found = log(s, r)
        if len(first) < 2:
            first.append(1)
            if len(first) == 2:
                commits._publish(s, r, {"version": found[-1]["version"] + 1, "epoch": "other", "data": {}, "keys": {}})
        return found

    monkeypatch.setattr(commits, "_entries", late)
    assert commits.commit(spark, root, {"samples": b(30)}, 6)
    assert [e["epoch"] for e in log(spark, root)][-2:] == ["other", "6"] and see("samples") == [(10,), (20,), (30,)]
    first.clear()
    first.append(1)
    with pytest.raises(commits.Conflict):
        monkeypatch.setattr(commits, "_entries", lambda s, r: late(s, r))
        commits.compact(spark, root, "samples")


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    root = kept.new_path(spark, "commits-test")
    rows = spark.createDataFrame([(k, f"v{k}") for k in range(20)], "id long, v string")
    source = str(tmp_path / "in")
    for low in (0, 10):
        rows.filter((F.col("id") >= low) & (F.col("id") < low + 10)).coalesce(1).write.mode("append").parquet(source)
        both = lambda df: {"sessions": df, "samples": df.select("id")}
        commits.commit_stream(spark.readStream.schema(rows.schema).parquet(source), root, str(tmp_path / "check"), both).awaitTermination(60)
    assert commits.read(spark, root, "sessions").count() == commits.read(spark, root, "samples").count() == 20
    assert commits.committed(spark, root) == {"stream-0", "stream-1"}


def test_segments_are_one_window(spark, monkeypatch):
    monkeypatch.setattr(skew, "SALTS", 3)
    rnd = random.Random(6)
    rows = [(s, rnd.randrange(5000), k, rnd.choice([None, float("nan"), rnd.uniform(0, 30), rnd.uniform(0, 6)]), rnd.choice([None, "a", "b"])) for k, s in enumerate(rnd.choices([1, 1, 1, 2, 3, None], k=900))]
    df = spark.createDataFrame(rows, "s long, t long, n long, score double, v string").repartition(3)
    order = ["t", "n"]
    same = lambda a, b, *c: sorted(repr(tuple(r)) for r in a.select("n", *c).collect()) == sorted(repr(tuple(r)) for r in b.select("n", *c).collect())
    for width in (100, 1700, 100_000):
        got, want = segments.motion_hysteresis(df, "s", "t", order, width, quiet=300), motion.motion_hysteresis(df.filter("s IS NOT NULL"), "s", "t", order, quiet=300)
        assert got.columns == [*df.columns, "moving"] and same(got.filter("s IS NOT NULL"), want, "moving")
        assert same(segments.cover_hysteresis(df, "s", "t", order, width, "score", "score"), motion.cover_hysteresis(df, "s", order, "score", "score"), "cover_suspected")
        assert same(segments.ordinals(df, "s", "t", order, width), sessions.ordinals(df, "s", order), "ordinal")
        assert same(segments.gaps(df, width, "s", "t", "n"), sessions.gaps(df, "s", "t", "n"), "gap_ms")
        asks = F.col("v") == "b"
        assert same(segments.latest_within(df, "s", "t", order, "score", asks, 50, width, "x"), motion.latest_within(df, "s", "t", order, "score", asks, 50, "x"), "x")
    assert segments.ordinals(df.limit(0), "s", "t", order, 10).count() == 0


def test_one_session_is_the_work_of_many_tasks(spark):
    """No window's partition, and no shuffled key, is the session alone, but for one row a segment."""
    df = spark.range(0, 200_000, 1, 4).select(F.lit(1).alias("s"), F.col("id").alias("t"), F.col("id").alias("n"))
    x = segments.ordinals(df, "s", "t", ["t", "n"], 1000)
    assert x.filter("ordinal <> t + 1").isEmpty()
    before = spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        rows = segments.ordinals(df, "s", "t", ["t", "n"], 1000).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before[0])
    assert len(rows) == 4 and max(r["count"] for r in rows) < 100_000


def matches(rows, steps, gaps, breaks):
    """Every chain of events, one after the other."""
    out = {}
    for s, i, k, t in rows:
        if k != steps[0] or s is None or t is None:
            continue
        ends, at = [], [t]
        for step, gap in zip(steps[1:], gaps, strict=True):
            at = [u for q, _, kind, u in rows if q == s and kind == step and u is not None and any(0 < u - v <= gap for v in at)]
        ends = [u for u in at if not any(q == s and kind in breaks and x is not None and t < x <= u for q, _, kind, x in rows)]
        if ends:
            out[i] = min(ends)
    return out


def events(seed, n=150, span=4000):
    rnd = random.Random(seed)
    return [(rnd.choice([1, 1, 2]), k, rnd.choice("aabbccxyz"), rnd.randrange(span)) for k in range(n)]


@pytest.mark.parametrize(("steps", "gaps", "breaks"), [("abc", [60, 90], ""), ("abc", [100, 200], "x"), ("aa", [50], "xy"), ("abab", [200, 300, 250], ""), ("a", [], "")])
def test_gapped_sequences(spark, steps, gaps, breaks):
    for seed in (1, 2):
        rows = [*events(seed), (None, 900, "a", 5), (1, 901, "a", None), (1, 902, "b", -70), (1, 903, "a", -100)]
        df = spark.createDataFrame(rows, "s long, i long, kind string, t long").repartition(3)
        out = sequences.gapped_sequences(df, "s", "kind", "t", list(steps), gaps, list(breaks))
        got = [(r.i, r.sequence_end) for r in out.collect()]
        want = matches(rows, steps, gaps, breaks)
        assert out.columns == [*df.columns, "sequence_end"] and dict(got) == want and len(got) == len(want) > 0
    with pytest.raises(ValueError, match="gap"):
        sequences.gapped_sequences(df, "s", "kind", "t", ["a", "b"], [])


def test_gapped_sequences_on_a_stream(spark, tmp_path):
    """Events out of order, a restart in between; the same rows as the batch form."""
    steps, gaps, breaks = ["a", "b", "c"], [400, 700], ["x"]
    rnd = random.Random(4)
    rows = sorted(events(4, 200, 20_000), key=lambda r: r[3] + rnd.randrange(300))
    rows.append((1, 999, "z", 60_000))  # moves the watermark past all others
    df = spark.createDataFrame([(s, i, k, t) for s, i, k, t in rows], "key long, event_id long, kind string, t_ms long").withColumn("ts", F.timestamp_millis("t_ms"))
    source, out, check = [str(tmp_path / x) for x in ("in", "out", "check")]
    for low, high in ((0, 90), (90, len(rows)), (-1, 0)):
        part = [(s, i, k, t) for s, i, k, t in rows[low:high]] if low >= 0 else [(1, 1000, "z", 70_000)]
        spark.createDataFrame(part, "key long, event_id long, kind string, t_ms long").withColumn("ts", F.timestamp_millis("t_ms")).coalesce(1).write.mode("append").parquet(source)
        stream = sequence_stream(spark.readStream.schema(df.schema).parquet(source), steps, gaps, breaks)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination(120)
    got = {r.event_id: r.sequence_end for r in spark.read.parquet(out).collect()}
    assert got == matches(rows, steps, gaps, breaks) and len(got) > 3
