import datetime

import pytest
from pyspark.sql import functions as F

from strandline import schemas
from strandline.functions import jpeg, scalars
from strandline.operators import manifest, quality, recovery, scope
from strandline.sources import readers, sinks

A = "00000000-0000-4000-8000-0000000000aa"


def uid(n):
    return f"00000000-0000-4000-8000-{n:012x}"


def meta(n, sha="a" * 64, size=10, **more):
    return {"frame_id": uid(n), "request_wall_ms": 1, "sha256": sha, "byte_length": size} | more


def image(w, h):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x01\x01\x11\x00\xff\xd9"


def catalog(spark, rows):
    return spark.createDataFrame(rows, schemas.schema("frames"))


def test_batches(spark):
    stored = catalog(spark, [(A, uid(1), "o", "d", meta(1), datetime.datetime(2024, 1, 1, 0, 0, 0, 120000)), (A, uid(2), "o", "d", meta(2), None)])
    rows = [
        ("b1", A, [meta(3), meta(1), meta(2)]),  # retry of two, one new
        ("b2", A, [meta(4), meta(2, sha="b" * 64)]),  # conflict: nothing is stored
        ("b3", A, [meta(5), meta(5)]),  # repeated id
        ("b4", A, [meta(6, size=0)]),
        ("b5", A, [meta(7), meta(8)]),
        ("b6", A, [meta(7, sha="c" * 64)]),  # conflict with an earlier batch of the run
    ]
    df = spark.createDataFrame(rows, f"batch_id string, archive_id string, frames array<{schemas.METADATA}>")
    v = manifest.batch_verdicts(manifest.explode_batches(df), stored)
    assert {r.batch_id: r.verdict for r in v.collect()} == {"b1": "accepted", "b2": "conflict", "b3": "invalid_request", "b4": "invalid_request", "b5": "accepted", "b6": "conflict"}
    assert {r.id for r in manifest.accepted_frames(v).join(stored, ["archive_id", "id"], "left_anti").collect()} == {uid(3), uid(7), uid(8)}
    answers = {r.batch_id: r for r in manifest.responses(v, stored).collect()}
    assert [f.frame_id for f in answers["b1"].frames] == [uid(3), uid(1), uid(2)]
    assert [f.state for f in answers["b1"].frames] == ["pending", "committed", "pending"]
    assert answers["b1"].frames[1].receipt.committed_at == "2024-01-01T00:00:00.12Z" and answers["b2"].error == "conflict"
    done, jobs = manifest.complete(stored, spark.createDataFrame([(A, uid(2)), (A, uid(1))], "archive_id string, id string"), datetime.datetime(2025, 1, 1))
    assert jobs.count() == 1 and done.filter("committed_at IS NULL").count() == 0


def test_audit_and_checks(spark):
    good, wide = image(16, 12), image(16385, 1)
    import hashlib

    sha = lambda b: hashlib.sha256(b).hexdigest()
    stored = catalog(spark, [(A, uid(1), "o", "d", meta(1, sha(good), len(good)), None), (A, uid(2), "o", "d", meta(2, sha(good), len(good)), None), (A, uid(3), "o", "d", meta(3, sha(wide), len(wide)), None), (A, uid(4), "o", "d", meta(4), None)])
    names = [f"{A}_{uid(1)}.jpg", f"{A}_{uid(9)}.jpg", "odd.txt", f".stage-{uid(5)}", ".lock"]
    r = recovery.audit(spark.createDataFrame([(n,) for n in names], "name string"), stored).first()
    assert (r.unknown, r.stages) == (2, 1)
    files = spark.createDataFrame([(A, uid(1), bytearray(good)), (A, uid(2), bytearray(good[:-1])), (A, uid(3), bytearray(wide))], "archive_id string, frame_id string, content binary")
    checked = recovery.check_originals(files, stored)
    assert {r.frame_id: r.code for r in checked.collect()} == {uid(1): None, uid(2): "checksum_mismatch", uid(3): "invalid_image"}
    assert {r.id: r.action for r in recovery.recovery_actions(stored, checked).collect()} == {uid(1): "complete", uid(2): "block", uid(3): "block", uid(4): "wait"}


def test_jpeg_limits(spark):
    for w, h, ok in ((16384, 1, True), (1, 16384, True), (8000, 5000, True), (16385, 1, False), (7000, 6000, False), (0, 5, False)):
        assert jpeg.dimensions(image(w, h)) == (w, h)
        assert spark.range(1).select(scalars.jpeg_size_ok(F.lit(w), F.lit(h))).first()[0] is ok
    for bad in (b"", b"\xff\xd8", b"\xff\xd8\xff\xd9", image(1, 1)[:10], b"\xff\xd8\x00\x00\x00\x00"):
        assert jpeg.dimensions(bad) is None


def test_local_recovery(spark):
    pre, own = "p/", "app"
    f = [dict(id=n, state=0, locator_kind="media", uri=u, relative_path=path, validated=v, sha256="h", bytes=5, actual_width=1, actual_height=1) for n, u, path, v in (("gone", "u0", "p/x/", 0), ("pend", "u1", "p/x/", 0), ("pub", "u2", "p/x/", 0), ("vgone", "u3", "p/x/", 1), ("vpend", "u4", "p/x/", 1), ("vchanged", "u5", "p/x/", 1), ("vpub", "u6", "p/x/", 1), ("evil", "u1", "q/..", 0), ("foreign", "u7", "p/x/", 0), ("byname", None, "p/x/", 1))]
    fields = schemas.schema("device_frames")
    frames = spark.createDataFrame([tuple(r.get(c.name) for c in fields) for r in f], fields)
    e = [("u1", "pend.jpg", "p/x/", own, True, 5, False), ("u2", "pub.jpg", "p/x/", own, False, 5, False), ("u4", "vpend.jpg", "p/x/", own, True, 5, False), ("u5", "vchanged.jpg", "p/x/", own, True, 5, False), ("u6", "vpub.jpg", "p/x/", own, False, 5, False), ("u7", "foreign.jpg", "p/x/", "other", True, 5, False), ("u8", "byname.jpg", "p/x/", own, False, 5, False)]
    entries = spark.createDataFrame(e, schemas.schema("media_entries"))
    contents = spark.createDataFrame([("u4", "h", 5, 1, 1), ("u5", "other", 5, 1, 1)], "uri string, sha256 string, bytes long, width int, height int")
    got = {r.id: r.action for r in recovery.pending_actions(frames, entries, contents, own, pre).collect()}
    assert got == {"gone": "quarantine", "pend": "delete", "pub": "blocked_published", "vgone": "commit_missing", "vpend": "publish", "vchanged": "blocked_changed", "vpub": "commit", "evil": "blocked_namespace", "foreign": "blocked_ownership", "byname": "commit"}
    done = frames.withColumn("state", F.lit(1))
    assert {r.id: r.available for r in recovery.availability(done, entries, own).collect()}["vpub"] == "AVAILABLE"


def test_integrity_and_cardinality(spark):
    owners, archives = spark.createDataFrame([("o",)], "id string"), spark.createDataFrame([("a", "o"), ("b", "x")], "id string, owner_id string")
    assert quality.integrity({"owners": owners, "archives": archives}).first().violations == 1
    assert quality.duplicates(spark.createDataFrame([(1,), (1,), (2,)], "k long"), ["k"]).collect()[0].n == 2
    bad = quality.exactly_one(spark.createDataFrame([(1,), (1,), (2,)], "k long"), spark.createDataFrame([(1,), (2,), (3,)], "k long"), ["k"])
    assert {(r.k, r.n) for r in bad.collect()} == {(1, 2), (3, 0)}
    m = spark.createDataFrame([(meta(1, profile={"id": "x", "requested_width": 0, "requested_height": 1, "jpeg_quality": 101}, capture_settings="a\x00"),)], f"metadata {schemas.METADATA}")
    assert m.select(quality.metadata_violations()).first()[0] == ["capture_settings", "profile.requested", "profile.jpeg_quality"]
    t = spark.createDataFrame([("2024-02-29T00:00:00Z",), ("2024-02-30T00:00:00Z",), ("x",)], "t string")
    assert [r[0] for r in t.select(quality.timestamps_valid(F.col("t"))).collect()] == [True, False, False]


def test_scope(spark):
    scope.declare(spark, "test_owner")
    df = spark.createDataFrame([("o", 1), ("p", 2)], "owner_id string, x long")
    view = scope.scoped(df, "owner_id", "test_owner")
    assert view.count() == 0
    scope.set_owner(spark, "o'\\", "test_owner")
    assert scope.scoped(df, "owner_id", "test_owner").count() == 0
    scope.set_owner(spark, "o", "test_owner")
    assert [r.x for r in scope.scoped(df, "owner_id", "test_owner").collect()] == [1]
    inv = spark.createDataFrame([("t", "a", datetime.datetime(2030, 1, 1), False), ("u", "a", datetime.datetime(2020, 1, 1), False)], schemas.schema("invitations"))
    arch = spark.createDataFrame([("a", "o")], "id string, owner_id string")
    req = spark.createDataFrame([("t", "x", "n"), ("t", "y", "n"), ("u", "z", "n")], "token_hash string, device_token_hash string, name string")
    new = scope.redeem(inv, arch, req, datetime.datetime(2025, 1, 1))
    assert [(r.token_hash, r.archive_id) for r in new.collect()] == [("x", "a")]
    later = req.withColumn("ingest_seq", F.when(F.col("device_token_hash") == "y", 1).otherwise(2))
    assert [r.token_hash for r in scope.redeem(inv, arch, later, datetime.datetime(2025, 1, 1)).collect()] == ["y"]  # the first to ask
    assert sinks.consume(inv, new).filter("consumed").count() == 1
    assert scope.authenticate(new, "x").count() == 1 and scope.authenticate(sinks.revoke(new, new.first().id), "x").count() == 0


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, s string, n long")
    assert sorted(map(tuple, sinks.update_one(old, spark.createDataFrame([(1, "z")], "k long, s string"), ["k"]).collect())) == [(1, "z", 1), (2, "b", 2)]
    with pytest.raises(ValueError):
        sinks.update_one(old, spark.createDataFrame([(9, "z")], "k long, s string"), ["k"])
    assert sinks.delete(old, F.col("k") == 1).count() == 1
    path = str(tmp_path / "t")
    sinks.publish(old, path)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.publish(old, path)
    sinks.append_absent(spark.createDataFrame([(2, "x", 0), (3, "c", 3), (3, "c", 3)], "k long, s string, n long"), path, ["k"])
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    for _ in range(2):
        sinks.append_batch({"a": old, "b": old}, str(tmp_path), 7)
    assert spark.read.parquet(str(tmp_path / "a.parquet")).count() == 2
    v3 = spark.createDataFrame([("a", "s", 5)], "attempt_id string, session_id string, camera_submit_elapsed_ms long")
    new = sinks.evolve(v3, "capture_attempts", {"camera_submit_elapsed_ms": "camera_invoke_ready_elapsed_ms"}, {"result": "PENDING"})
    assert [(f.name, f.dataType) for f in new.schema] == [(f.name, f.dataType) for f in schemas.schema("capture_attempts")] and (new.first().camera_invoke_ready_elapsed_ms, new.first().result) == (5, "PENDING")


def test_sources(spark, tmp_path):
    (tmp_path / f"{A}_{uid(1)}.jpg").write_bytes(image(4, 3))
    (tmp_path / f".stage-{uid(2)}").write_bytes(b"x")
    folder = f"file://{tmp_path}"
    assert [r.name for r in readers.originals(spark, folder).collect()] == [f"{A}_{uid(1)}.jpg"]
    assert [r.name for r in readers.staged(spark, folder).collect()] == [f".stage-{uid(2)}"]
    r = readers.content_facts(readers.originals(spark, folder, content=True)).first()
    assert (r.width, r.height, r.marked) == (4, 3, True)
    assert readers.legacy_originals(spark, folder).count() == 1
    e = spark.createDataFrame([("u", "n", "p", "o", True, 1, False), ("v", "n", "p", "o", False, 1, False), ("w", "n", "p", "o", False, 1, True)], schemas.schema("media_entries"))
    assert [r.uri for r in readers.media(e).collect()] == ["v"] and readers.media(e, pending=True, trashed=True).count() == 3
    df = spark.createDataFrame([(a, b) for a in range(3) for b in range(3)], "a long, b long")
    assert [tuple(r) for r in readers.keyset_page(df, ["a", "b"], [1, 1], 3).collect()] == [(1, 2), (2, 0), (2, 1)]
    with pytest.raises(ValueError):
        schemas.check_version(3)


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(scalars.is_uuid(F.lit(A))) and not get(scalars.is_uuid(F.lit(A.upper())))
    assert get(scalars.is_token(F.lit("A" * 43))) and not get(scalars.is_token(F.lit("A" * 42 + "B")))
    assert tuple(get(scalars.battery(F.lit(50), F.lit(200)))) == (50, 200, 25.0)
    for level, scale in ((-1, 100), (101, 100), (50, 0), (50, -1), (None, None)):
        assert tuple(get(scalars.battery(F.lit(level).cast("int"), F.lit(scale).cast("int")))) == (None, None, None)
    assert get(scalars.duration_text(F.lit(3_725_999))) == "1:02:05"
    assert get(scalars.valid_text(F.lit("📷é"), 2, 2)) and not get(scalars.valid_text(F.lit("a\x00"), 1, 5))
    assert get(scalars.csv_line(F.lit('a,"b'), F.lit(None).cast("string"), F.lit(3))) == '"a,""b",,3'
    assert get(scalars.path_stamp(F.lit(0))) == "19700101-000000"
    assert get(scalars.settings_map(F.lit("v2;a=1;rear")))["a"] == "1"
    assert get(scalars.sample_size(F.lit(4000), F.lit(3000), F.lit(1000))) == 4
    assert get(scalars.origin_ok(F.lit("https://a.example:8443"))) and not get(scalars.origin_ok(F.lit("http://a"))) and not get(scalars.origin_ok(F.lit("https://a:99999")))
    assert get(scalars.content_uri_ok(F.lit("content://media/external/1"))) and not get(scalars.content_uri_ok(F.lit("file:///x")))
    assert get(scalars.is_uuid(scalars.new_id(F.lit("x"))))
    assert get(F.size(scalars.grid_sample(F.sequence(F.lit(0), F.lit(9999)), F.lit(100), F.lit(1), F.lit(0), F.lit(0), F.lit(64), F.lit(48)))) == 768
    assert get(scalars.seconds_since(F.lit(1000), F.lit(5000))) == 0
    with pytest.raises(ValueError):
        scalars.expires(F.current_timestamp(), 601)


def test_conditional_rules(spark):
    df = spark.createDataFrame([("pending", None, "unavailable", True), ("committed", None, "conflict", True)], "state string, receipt string, code string, retryable boolean")
    assert [tuple(r) for r in df.select(*[c.alias(n) for n, c in quality.document_violations().items()]).collect()] == [(True, True), (False, False)]


def test_catalog_differences(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS strandline_test")
    try:
        schemas.create_tables(spark, "strandline_test")
        assert schemas.catalog_differences(spark, "strandline_test").count() == 0
        spark.sql("DROP TABLE strandline_test.owners")
        spark.sql("CREATE TABLE strandline_test.owners (id INT, more STRING) USING parquet")
        got = {(r.table, r.column, r.status) for r in schemas.catalog_differences(spark, "strandline_test").collect()}
        assert got == {("owners", "id", "type"), ("owners", "more", "extra")}
    finally:
        spark.sql("DROP DATABASE strandline_test CASCADE")


def test_large_originals_are_told(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"12345")
    (tmp_path / "b.jpg").write_bytes(b"1")
    got = {r["name"]: r["content"] for r in readers.originals(spark, f"file://{tmp_path}", content=True, most=3).collect()}
    assert got["a.jpg"] is None and bytes(got["b.jpg"]) == b"1"


def test_new_archives(spark):
    owners, archives = sinks.create_archive("o", "a", spark)
    assert owners.first().id == "o" and scope.archive_owner(archives, "a").first().owner_id == "o"
    assert scope.archive_owner(archives, "b").count() == 0
