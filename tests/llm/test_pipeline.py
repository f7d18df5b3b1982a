"""The stages of the pipeline, one after the other, on odd, empty and fully labelled tables."""

import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from compare import DATA
from fixtures import DOCS, covered_words, odd_rows, passage, shingles
from pyspark.sql import functions as F

import corpus_pipeline

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture
def folder(spark, tmp_path):
    def write(rows, labels, ddl=DOCS):
        path = f"file://{tmp_path}/{hashlib.sha256(repr((rows, labels)).encode()).hexdigest()[:8]}"
        spark.createDataFrame(rows, ddl).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
        return path

    return write


def encoding():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_stages_return_documents(spark, folder):
    path = folder(odd_rows(), [(1, 1, 0)])
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("extra", F.lit("x"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == list(corpus_pipeline.COLUMNS), name


def plain(rows):
    """Near-dedup and substring dedup as their definitions say, for tables that the classifiers let pass whole."""
    sets = [shingles(r[1], 5) for r in rows]
    label = [r[0] if r[0] is not None else -k for k, r in enumerate(rows, 1)]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                a, b = sets[i], sets[j]
                if a and b and 100 * len(a & b) >= 80 * len(a | b) and label[i] != label[j]:
                    low = min(x for x in (label[i], label[j]) if x > 0) if max(label[i], label[j]) > 0 else max(label[i], label[j])
                    label[i] = label[j] = low
                    changed = True
    kept = [r for k, r in enumerate(rows) if label[k] == r[0] or label[k] < 0]
    return [(r[0], k.decode()) for r, (_, _, k) in zip(kept, covered_words(kept, 35), strict=True)]


def test_odd_rows_without_labels(spark, folder):
    """Nothing to learn from: every document passes the first stage and stays once in the fourth."""
    path = folder(odd_rows(), [])
    out = corpus_pipeline.run(spark, path).collect()
    want = sorted(plain(odd_rows()), key=repr)
    e = encoding()
    ids = [list(struct.unpack(f"<{len(r.ids) // 4}I", bytes(r.ids))) for r in out]
    assert sorted(((r.doc_id, e.decode(i)) for r, i in zip(out, ids, strict=True)), key=repr) == want
    assert all(i == e.encode_ordinary(e.decode(i)) and r.n_tokens == len(i) for r, i in zip(out, ids, strict=True))
    assert all(r.decoded_sha256 == hashlib.sha256(e.decode(i).encode()).hexdigest() for r, i in zip(out, ids, strict=True))


def test_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, folder([], [])).count() == 0


def test_all_labelled(spark, folder):
    """Labels for every row: documents are told apart by their text, not all rejected."""
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    labels = [(r[0], int(k % 7 != 0), 0) for k, r in enumerate(rows)]
    path = folder(rows, labels)
    assert 0 < corpus_pipeline.quality(spark, spark.read.parquet(f"{path}/documents.parquet"), path).count()


def test_clean_rows_are_kept(spark, folder):
    """Different clean texts come out as they were."""
    rows = [(k, passage(1000 + 13 * k, 120), "en", "a", 0) for k in range(40)]
    path = folder(rows, [(k, 1, 0) for k in range(0, 40, 2)])
    out = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in out} == set(range(40))
