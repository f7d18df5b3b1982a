import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import odd_rows

from strandline.llm import resampling
from strandline.llm.resampling import importance_resample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, most):
    w = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(w), [b" ".join(w[k : k + n]) for n in range(1, most + 1) for k in range(len(w) - n + 1)]


def brute(rows, target, most=1, buckets=10_000, least=20, part=(10, 100), seed="2024"):
    """One document at a time; sorted rows of doc_id, n_features, weight and score, and those drawn in order."""
    bucket = lambda x: zlib.crc32(x) % buckets
    s = Counter(bucket(f) for r in rows for f in features(r[1], most)[1])
    t = Counter(bucket(f) for r in target for f in features(r, most)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out, able = [], []
    for r in rows:
        n, f = features(r[1], most)
        h = int(hashlib.sha256(f"{seed}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(x)] for x in f)
        out.append((r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
        if n >= least:
            able.append(out[-1])
    able.sort(key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    return sorted(out, key=repr), able[: part[0] * len(able) // part[1]]


def assert_brute(df, *expected):
    rows = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()]
    every, drawn = expected
    assert sorted((r[:4] for r in rows), key=repr) == every
    assert [r[:4] for r in sorted((r for r in rows if r[4]), key=lambda r: r[4])] == drawn
    assert sorted(r[4] for r in rows if r[4]) == list(range(1, len(drawn) + 1))


def texts():
    rows = [(r[0], r[1]) for r in odd_rows()]
    rows += [(1000 - k, " ".join(f"w{(k * i) % 37}" for i in range(15 + k % 30))) for k in range(150)]
    return rows + [(2000 + k, "The same WORDS, all over; again " * 5) for k in range(60)] + [(2003, "The same WORDS, all over; again " * 5)]


TARGET = ["w1 w2 w3 same words", None, "", "W5 W6 漢字 one two x", "w1 w2 w3 same words"]


@pytest.mark.parametrize(("most", "buckets", "least", "part", "salts"), [(1, 10_000, 20, (10, 100), 256), (3, 97, 1, (1, 2), 3), (2, 1000, 0, (1, 1), 1), (1, 1, 10**6, (1, 1), 2)])
def test_draw(spark, monkeypatch, most, buckets, least, part, salts):
    monkeypatch.setattr(resampling, "SALTS", salts)
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    out = importance_resample(docs, target, most_words=most, buckets=buckets, least_words=least, part=part)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert_brute(out, *brute(texts(), TARGET, most, buckets, least, part))


def test_other_columns_stay_and_clashing_ones_go(spark, odd):
    docs = odd.withColumnRenamed("lang", "digest").withColumnRenamed("source", "rank")
    out = importance_resample(docs, docs.select("text"), least_words=5)
    assert out.columns == ["doc_id", "digest", "n_chars", "n_features", "weight", "score", "rank"]
    assert sorted((repr(r.doc_id), r.digest) for r in out.collect() if r.digest) == sorted((repr(r[0]), r[2]) for r in odd_rows() if r[2])


def test_empty_tables(spark, odd, none):
    assert importance_resample(none, odd).count() == 0
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert_brute(importance_resample(odd.select("doc_id", "text"), none, least_words=2, part=(1, 2)), *brute(rows, [], least=2, part=(1, 2)))


def test_words_of_long_and_joined_texts():
    """Words end where texts do, whatever stands beside them."""
    rnd = np.random.default_rng(1)
    data = [b"ab", b"cd ef", b"", b"\xc3\xa4\xc3\xb6", b"1", rnd.integers(0, 128, 300_000).astype(np.uint8).tobytes(), b"Z"]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in data])))
    for most in (1, 2):
        bucket, sizes, n = resampling.buckets_of(np.frombuffer(b"".join(data), np.uint8), offsets, most, 1000)
        want = [features(x.decode(), most) for x in data]
        assert n.tolist() == [w[0] for w in want] and sizes.tolist() == [len(w[1]) for w in want]
        assert bucket.tolist() == [zlib.crc32(f) % 1000 for w in want for f in w[1]]


def test_copies_are_weighed_once(spark):
    rows = [(k, "one text") for k in range(50)] + [(50, "another"), (51, None), (52, "")]
    df = resampling.distinct_features(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("coalesce(text, '') AS text"), 1, 100)
    assert sorted(r.copies for r in df.collect()) == [1, 2, 50] and resampling.bucket_counts(df, 100).sum() == 101


def test_documents_match_brute_force(spark):
    from compare import DATA

    from strandline.llm.queries import op13_importance_resampling

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    assert_brute(op13_importance_resampling(spark, DATA), *brute(rows, target))
