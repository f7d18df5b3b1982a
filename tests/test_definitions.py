import json
import os
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import definitions, distributions, sessions
from strandline.sources.listing import BATCH, listing

ID, SHA, TOKEN, TIME = "0a1b2c3d-0000-4000-8000-00000000abcd", "0f" * 32, "B" * 42 + "A", "2024-02-29T01:02:03.5Z"
META = {"frame_id": ID, "request_wall_ms": 5, "sha256": SHA, "byte_length": 9}
PROFILE = {"id": "p", "requested_width": 4000, "requested_height": 3000, "jpeg_quality": 90}
RECEIPT = {"contract_version": "0.1.0", "archive_id": ID, "frame_id": ID, "sha256": SHA, "byte_length": 9, "committed_at": TIME, "integrity": "sha256-byte-length-jpeg-header", "state": "archive_committed"}


def error(code, retryable, **more):
    return {"error": {"code": code, "message": "m", "retryable": retryable, **more}}


#: name of the definition, document, and all that is violated.
CASES = [
    ("version", "0.1.0", []), ("version", "0.2.0", [("", "const")]), ("version", 1, [("", "type"), ("", "const")]),
    ("uuid", ID, []), ("uuid", ID.upper(), [("", "pattern")]), ("uuid", ID[1:], [("", "minLength"), ("", "pattern")]),
    ("sha256", SHA.upper(), [("", "pattern")]), ("token", TOKEN, []), ("token", TOKEN + "=", [("", "maxLength"), ("", "pattern")]), ("token", TOKEN[:-1] + "B", [("", "pattern")]),
    ("time", TIME, []), ("time", "2023-02-29T01:02:03Z", [("", "format")]), ("time", "2024-02-29T01:02:03+00:00", [("", "pattern")]), ("time", 5, [("", "type")]),
    ("milliseconds", 9007199254740991, []), ("milliseconds", 9007199254740992, [("", "maximum")]), ("milliseconds", 1.5, [("", "type")]), ("milliseconds", 2.0, []), ("milliseconds", None, [("", "type")]), ("milliseconds", True, [("", "type")]),
    ("pairing", {"invitation_token": TOKEN, "device_name": "d"}, []), ("pairing", {"invitation_token": TOKEN, "device_name": ""}, [("device_name", "minLength")]),
    ("pairing", {"invitation_token": TOKEN, "device_name": "d", "owner_id": ID}, [("", "additionalProperties")]), ("pairing", {"invitation_token": TOKEN, "device_name": "a\x00"}, [("device_name", "pattern")]), ("pairing", [], [("", "type")]),
    ("profile", PROFILE, []), ("profile", {**PROFILE, "jpeg_quality": 0}, [("jpeg_quality", "minimum")]), ("profile", {**PROFILE, "x": {}}, [("", "additionalProperties")]), ("profile", {**PROFILE, "negotiated_width": None}, []),
    ("profile", {**PROFILE, "negotiated_width": 0}, [("negotiated_width", "anyOf")]),
    ("metadata", {**META, "capture_settings": None, "profile": PROFILE}, []), ("metadata", {k: v for k, v in META.items() if k != "frame_id"}, [("", "required")]), ("metadata", {**META, "request_wall_ms": None}, [("request_wall_ms", "type")]),
    ("metadata", {**META, "capture_settings": "x" * 2049}, [("capture_settings", "maxLength")]), ("metadata", {**META, "capture_settings": 3}, [("capture_settings", "type")]),
    ("manifest", {"frames": []}, [("frames", "minItems")]), ("manifest", {"frames": [META] * 100}, []), ("manifest", {"frames": [META] * 101}, [("frames", "maxItems")]),
    ("manifest", {"frames": [META, {**META, "sha256": "x"}, {**META, "byte_length": 0}]}, [("frames/1/sha256", "minLength"), ("frames/1/sha256", "pattern"), ("frames/2/byte_length", "minimum")]), ("manifest", {"frames": {}}, [("frames", "type")]),
    ("frame", {"frame_id": ID, "state": "committed", "receipt": RECEIPT}, []), ("frame", {"frame_id": ID, "state": "pending", "receipt": None}, []), ("frame", {"frame_id": ID, "state": "committed", "receipt": None}, [("receipt", "type")]),
    ("frame", {"frame_id": ID, "state": "pending"}, [("", "required")]), ("frame", {"frame_id": ID, "state": "pending", "receipt": RECEIPT}, [("receipt", "type")]),
    ("frame", {"frame_id": ID, "state": "committed", "receipt": {**RECEIPT, "state": "committed"}}, [("receipt", "anyOf"), ("receipt/state", "const")]),
    ("error", error("unavailable", True), []), ("error", error("conflict", False), []), ("error", error("unavailable", False), [("error/retryable", "const")]), ("error", error("sql", False), [("error/code", "enum")]), ("error", error("conflict", False, stack="s"), [("error", "additionalProperties")]),
    ("error", {"error": {}}, [("error", "required")] * 3), ("error", {}, [("", "required")]),
]


def test_each_violation_has_its_path_and_keyword(spark):
    for name in {c[0] for c in CASES}:
        rows = [(k, json.dumps(doc), want) for k, (n, doc, want) in enumerate(CASES) if n == name]
        df = spark.createDataFrame([r[:2] for r in rows], "k long, doc string")
        got = {r.k: [tuple(x) for x in r.found] for r in df.select("k", definitions.compile_definition(name, F.col("doc")).alias("found")).collect()}
        for k, _, want in rows:
            assert sorted(got[k]) == sorted(want), CASES[k]


def test_documents_that_are_none(spark):
    df = spark.createDataFrame([(1, None), (2, "{"), (3, ""), (4, '"x"'), (4, '"x"')], "path long, doc string")
    found = df.select("path", definitions.compile_definition("version", F.col("doc")).alias("f")).collect()
    assert {r.path: r.f and [tuple(x) for x in r.f] for r in found} == {1: None, 2: [("", "json")], 3: [("", "json")], 4: [("", "const")]}
    out = definitions.violations(df, "doc", "version")
    assert out.columns == ["doc", "path", "keyword"] and out.count() == 4
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(ValueError, match="not known"):
        definitions.compile_definition({"patternProperties": {}}, F.lit("{}"))


@pytest.mark.parametrize("name", ["error", "manifest"])
def test_values_are_worked_out_once(spark, name):
    """However many words look at a document, it is parsed at one place, and so are its frames."""
    plan = definitions.violations(spark.createDataFrame([(1, "{}")], "k long, doc string"), "doc", name)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") == 1 and plan.lower().count("array<variant>") + plan.lower().count("arraytype(varianttype") <= 2


def test_types_are_told_without_schemas(spark):
    """Objects and arrays of anything are told from scalars, and their schema is not worked out; nothing takes an element of an array just made."""
    texts = {
        "object": ["{}", '{"a": [1, {}]}'], "array": ["[]", "[1]", '["a", null, [2], {"b": 1}]', "[[]]", "[{}]"], "string": ['""', '"OBJECT<>"', '"[]"', '"12"'], "boolean": ["true", "false"], "null": ["null"],
        "number": ["0", "-12", "1.5", "1e3", "1e300", "12345678901234567890123"],
    }
    df = spark.createDataFrame([(kind, x) for kind, xs in texts.items() for x in xs], "kind string, doc string")
    names = ["object", "array", "string", "boolean", "null", "number"]
    found = df.select("kind", "doc", *[(F.size(definitions.compile_definition({"type": n}, F.col("doc"))) == 0).alias(n) for n in names]).collect()
    assert [(r.doc, [n for n in names if r[n]]) for r in found] == [(r.doc, [r.kind]) for r in found]
    plan = definitions.violations(df, "doc", "error")._jdf.queryExecution().analyzed().toString()
    i = plan.index("schema_of_variant")
    assert "struct<>" in plan[:i].lower() or "structtype()" in plan[:i].lower() or "StructType" in plan[:i]
    assert "get(transform(" not in plan.replace("\n", "")


def test_not_and_all_of(spark):
    d = {"allOf": [{"type": "string"}, {"minLength": 2}], "not": {"pattern": "\\s"}}
    found = spark.range(1).select(*[definitions.compile_definition(d, F.lit(x)).alias(f"c{k}") for k, x in enumerate(('"ab"', '"a b"', '"a"', "1"))]).first()
    assert [[tuple(x) for x in c] for c in found] == [[], [("", "not")], [("", "minLength")], [("", "type"), ("", "not")]]


@pytest.mark.parametrize("band", [None, 0.0])
def test_percentiles_are_exact(spark, monkeypatch, band):
    """Groups of one value to many, ties, nulls; with no band at all nearly every rank is missed, and found by the other way."""
    if band is not None:
        monkeypatch.setattr(distributions, "BAND", band)
    rnd = random.Random(3)
    rows = [(1, rnd.randrange(10**6)) for _ in range(20_000)] + [(2, rnd.choice([1, 2, 2, 2, 9])) for _ in range(500)] + [(3, 7), (4, None), (5, -4), (5, None), (5, 1 << 52)]
    df = spark.createDataFrame(rows, "s long, v long").repartition(4)
    parts = distributions.sketches(df.withColumn("day", F.pmod(F.xxhash64("v"), F.lit(5))), ["s", "day"], "v")
    whole = distributions.merged(parts, ["s"]).cache()
    got = {r.s: r for r in distributions.exact(df, whole, "s", "v", {"p50": (0.5, "nearest"), "p95": (0.95, "nearest"), "f95": (0.95, "floor")}).collect()}
    want = df.groupBy("s").agg(sessions.distribution("v").alias("d")).join(sessions.floor_ranks(df, "s", "v", 0.95, "f"), "s").collect()
    for r in want:
        if r.d is not None:
            assert (got[r.s].p50, got[r.s].p95, got[r.s].most, got[r.s].f95) == (r.d.p50, r.d.p95, r.d.max, r.f)
    assert set(got) == {1, 2, 3, 5}
    about = distributions.approximate(whole, 0.5, "m").filter("s = 1").first().m
    values = sorted(v for s, v in rows if s == 1)
    assert abs(sum(v <= about for v in values) / len(values) - 0.5) < 0.02


def test_listing_is_dealt_out(spark, tmp_path):
    names = [f"{k:x}-{k}.jpg" for k in range(3 * BATCH)] + [".stage-1", ".lock", "_x", "Ünï", "+plus"]
    for n in names:
        (tmp_path / n).write_bytes(b"x" * (len(n) % 7))
    (tmp_path / "folder").mkdir()
    os.symlink(tmp_path / ".lock", tmp_path / "link")
    df = listing(spark, f"file://{tmp_path}", tasks=5)
    rows = df.collect()
    assert sorted(r.name for r in rows) == sorted(names) and all(r.bytes == len(r.name) % 7 and r.modified_ms > 1.6e12 for r in rows)
    spread = df.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) == 6 and max(r["count"] for r in spread) < len(names) / 2
    (tmp_path / "none").mkdir()
    assert listing(spark, str(tmp_path / "none")).count() == 0
