"""Batches in order of arrival, against a loop over them."""

import random

import pytest
from compare import DATA
from pyspark.sql import functions as F

from strandline import schemas
from strandline.operators import manifest, skew

A = "a"


def uid(n):
    return f"{n:08x}-0000-4000-8000-000000000000"


def meta(n, sha="a", size=10):
    return (uid(n), 1, sha * 64, size, None, None, None, None, None)


def plain(batches, stored):
    """Verdict by batch, and what is registered in the end."""
    known, out = dict(stored), {}
    for b, frames in sorted(batches.items()):
        ids = [m[0] for m in frames]
        if not 1 <= len(frames) <= manifest.MOST_FRAMES or len(set(ids)) < len(ids) or any(not 1 <= m[3] <= 10**6 for m in frames):
            out[b] = "invalid_request"
        elif any(known.get(m[0], m) != m for m in frames):
            out[b] = "conflict"
        else:
            out[b] = "accepted"
            known.update({m[0]: m for m in frames})
    return out, known


def run(spark, batches, stored, rounds=None):
    df = spark.createDataFrame([(b, A, f) for b, f in batches.items()], f"batch_id long, archive_id string, frames array<{schemas.METADATA}>").repartition(3)
    catalog = spark.createDataFrame([(A, i, "o", "d", m, None) for i, m in stored.items()], schemas.schema("frames"))
    frames = manifest.explode_batches(df)
    if rounds is not None:
        return {r.batch_id: r.verdict for r in manifest.batch_decisions(frames, catalog, rounds)[0].collect()}
    return manifest.batch_verdicts(frames, catalog)


@pytest.mark.parametrize("seed", range(6))
def test_random_batches(spark, monkeypatch, seed):
    """Few ids and contents: batches that are invalid, repeat an id, are sent again, or hang on others."""
    monkeypatch.setattr(skew, "SALTS", 1 + seed)
    rnd = random.Random(seed)
    stored = {uid(n): meta(n, "abc"[n % 3]) for n in range(0, 60, 9)}
    batches = {}
    for b in range(150):
        ids = [rnd.randrange(60 if seed % 2 else 12) for _ in range(rnd.randrange(1, 5))]
        if rnd.random() < 0.8:
            ids = list(dict.fromkeys(ids))
        batches[b] = [meta(n, rnd.choice("aaab"), 0 if rnd.random() < 0.05 else 10) for n in ids]
        if rnd.random() < 0.1 and b:
            batches[b] = batches[rnd.randrange(b)]
    want, registered = plain(batches, stored)
    v = run(spark, batches, stored)
    got = v.collect()
    assert {r.batch_id: r.verdict for r in got} == want and len(set(want.values())) == 3
    assert len(got) == sum(len(f) for f in batches.values())
    new = {r.id: tuple(r.metadata) for r in manifest.accepted_frames(v).collect()}
    assert new == {i: m for i, m in registered.items() if i not in stored}
    assert manifest.accepted_frames(v).count() == len(new)


def test_refused_batches_bind_no_one(spark):
    """The first batch has a frame with other contents and a broken one: neither is kept, so the second may come."""
    v = run(spark, {1: [meta(1, "a"), meta(2, size=0)], 2: [meta(1, "b")], 3: [meta(1, "a")], 4: [meta(1, "b"), meta(3)]}, {}).collect()
    assert {r.batch_id: r.verdict for r in v} == {1: "invalid_request", 2: "accepted", 3: "conflict", 4: "accepted"}
    assert {(r.batch_id, r.frame_id) for r in v if r.is_new} == {(2, uid(1)), (4, uid(3))}
    assert {(r.batch_id, r.frame_id) for r in v if not r.frame_ok} == {(1, uid(2)), (3, uid(1))}


def test_rounds(spark):
    """An id that all batches share, and a chain in which each batch hangs on the one before."""
    rounds = []
    shared = {b: [meta(0, "ab"[b % 2]), meta(b + 1)] for b in range(300)}
    assert run(spark, shared, {}, rounds) == plain(shared, {})[0] and len(rounds) == 2
    chain = {b: [meta(b, "a"), meta(b + 1, "b")] for b in range(8)}
    rounds = []
    want = plain(chain, {})[0]
    assert run(spark, chain, {}, rounds) == want and set(want.values()) == {"accepted", "conflict"}
    assert rounds == sorted(rounds, reverse=True) and rounds[-1] == 0 and len(rounds) <= 8


def test_empty_and_odd(spark):
    assert run(spark, {}, {uid(1): meta(1)}).count() == 0
    many = {1: [meta(n) for n in range(101)], 2: [meta(n) for n in range(100)], 3: [(None, *meta(1)[1:])]}
    v = {r.batch_id: r.verdict for r in run(spark, many, {}).collect()}
    assert v == {1: "invalid_request", 2: "accepted", 3: "invalid_request"}


def test_receipts_have_the_contracts_members(spark):
    row = spark.createDataFrame([(A, uid(1), "o", "d", meta(1), None), (A, uid(2), "o", "d", meta(2), None)], schemas.schema("frames"))
    row = row.withColumn("committed_at", F.when(F.col("id") == uid(1), F.timestamp_micros(F.lit(1_700_000_000_120_000))))
    got = {r.id: r for r in manifest.receipts(row).collect()}
    assert got[uid(2)].receipt is None and got[uid(2)].state == "pending"
    assert got[uid(1)].receipt.asDict() == {
        "contract_version": "0.1.0", "archive_id": A, "frame_id": uid(1), "sha256": "a" * 64, "byte_length": 10, "committed_at": "2023-11-14T22:13:20.12Z",
        "integrity": "sha256-byte-length-jpeg-header", "state": "archive_committed",
    }


def test_contents_move_as_bytes(spark):
    """Contents of frames are hashes of 32 bytes where they are shuffled, and metadata is made after batches are counted."""
    from strandline.plans import catalogue

    frames, catalog = catalogue._batches(spark, DATA), catalogue._catalog(spark, DATA)
    facts = manifest._facts(frames, catalog)
    assert dict(facts.dtypes)["content"] == dict(facts.dtypes)["stored"] == "binary"
    assert facts.select(F.length("content")).distinct().collect() == [(32,)]
    plan = frames._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan[plan.index("Window") :]
