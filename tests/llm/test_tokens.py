import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from fixtures import odd_rows

from strandline.llm import bpe
from strandline.llm import token_files as tf

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
ALPHABET = "ab \n\t'sé漢字  .,!?ΔthertionANDing0123🤦 \x85\x1c "


@pytest.fixture(scope="module")
def encoder():
    return bpe.encoder(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_text(rnd, n=60):
    return "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, n)))


def ids_of(reference, text):
    return np.array(reference.encode_ordinary(text), "<u4").tobytes()


def test_pattern():
    assert bpe.PATTERN == P.PATTERN


def test_encoder_matches(encoder, reference):
    rnd = random.Random(2)
    texts = [random_text(rnd) for _ in range(1500)] + [r[1] or "" for r in odd_rows()] + ["<|endoftext|> a", " ", "  a", "a ", "\n\n x"]
    for text, got in zip(texts, encoder.encode_column(pa.array(texts, pa.string())), strict=True):
        assert got == ids_of(reference, text), repr(text)
        assert encoder.decode(got) == text.encode()


def test_edits_and_appends(encoder, reference):
    rnd = random.Random(3)
    for _ in range(500):
        text = random_text(rnd)
        a = rnd.randint(0, len(text))
        b = rnd.randint(a, len(text))
        new = random_text(rnd, 9)
        edited, ids = encoder.reencode(text, encoder.encode(text), a, b, new)
        assert edited == text[:a] + new + text[b:] and ids == ids_of(reference, edited)
        data, more = text.encode(), new.encode()
        whole = bpe.PrefixTable(encoder.v, data + more)
        assert bpe.PrefixTable(encoder.v, data).append(more).last == whole.last
        assert bpe.PrefixTable(encoder.v, data + more).edit(len(data) // 2, len(data), b"xyz").last == bpe.PrefixTable(encoder.v, data[: len(data) // 2] + b"xyz" + more).last


def test_prefixes_are_all_encoded(encoder, reference):
    table = bpe.PrefixTable(encoder.v, b"understanding123")
    for n in range(1, 17):
        part = bpe.PrefixTable(encoder.v, table.data[:n])
        assert part.last == table.last[: n + 1]


def test_small_caches(encoder, reference, monkeypatch):
    monkeypatch.setattr(bpe.chunks, "CACHED", 5)
    monkeypatch.setattr(bpe.chunks, "LONGEST", 3)
    e = bpe.Encoder(encoder.v, P.PATTERN)
    rnd = random.Random(4)
    for _ in range(100):
        texts = [random_text(rnd) for _ in range(3)]
        assert e.encode_column(pa.array(texts, pa.string())) == [ids_of(reference, t) for t in texts]


def test_bpe_operator(odd, none, spark, reference):
    out = bpe.bpe_round_trip(odd, RANKS, P.PATTERN).collect()
    want = Counter((r[0], hashlib.sha256(ids_of(reference, r[1] or "")).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in odd_rows())
    assert Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in out) == want
    assert all(r.decoded == (r.text or "") and len(r.ids) == 4 * r.n_tokens for r in out)
    assert bpe.bpe_round_trip(none, RANKS, P.PATTERN).count() == 0
    df = spark.createDataFrame([(1, "a b", 5)], "ids long, text string, n_tokens long")
    assert bpe.bpe_round_trip(df, RANKS, P.PATTERN).columns == ["text", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    assert bpe.bpe_round_trip(df.select("text"), RANKS, P.PATTERN, with_ids=False, with_text=False).first().n_tokens == 2


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5, 5, 9], [2**63], list(range(0, 3000, 3)), [1] * 1000 + [10**12]])
def test_elias_fano(values):
    packed = b"pad" + tf.EliasFano.pack(np.array(values, np.uint64)) + b"more"
    e = tf.EliasFano(packed, 3)
    assert e.run(0, len(values)).tolist() == values == [e.select(i) for i in range(len(values))]
    for i in range(0, len(values), 97):
        for j in {i, i + 1, min(i + 300, len(values)), len(values)}:
            assert e.run(i, j).tolist() == values[i:j]
    assert packed[e.end :] == b"more"
    with pytest.raises(IndexError):
        e.select(len(values))


def test_elias_fano_is_small():
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 40, 50_000))
    assert len(tf.EliasFano.pack(v)) * 8 / len(v) < 2 + np.log2((1 << 40) / len(v)) + 0.5


def test_token_files(odd, none, spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    path = f"file://{tmp_path}/t"
    told = [(20, "<|endoftext|>"), (21, "a <|endoftext|> b"), (22, "one two\n<|endoftext|>"), (23, "x<|endoftext|><|endoftext|> y z. <|endoftext"), (24, None)]
    tf.write_token_files(odd.unionByName(spark.createDataFrame(told, "doc_id long, text string"), allowMissingColumns=True), path, JSON)
    out = tf.read_token_files(spark, path).collect()
    rows = sorted([*odd_rows(), *told], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for r in rows:
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in sorted(out, key=lambda r: r.start)] == want
    plain = tf.WordEncoder(JSON, plain=True)
    t.encode_special_tokens = True
    assert [x.tolist() for x in plain.encode(pa.array([x[1] for x in told]))] == [t.encode(x[1] or "", add_special_tokens=False).ids for x in told]
    tf.write_token_files(none, f"file://{tmp_path}/none", JSON)
    assert tf.read_token_files(spark, f"file://{tmp_path}/none").count() == 0


def test_several_segments(spark, tmp_path, monkeypatch):
    held = tf.pack_segment(3, 2, [None, 5, 9], [b"\x01\x00", b"", b"\x02\x00\x03\x00"]) + b"\n" + tf.pack_segment(3, 2, [10], [b"\x07\x00"]) + b"\n"
    a, b = list(tf.segments(held))
    assert a.doc_ids(0, 3) == [None, 5, 9] and a.doc_ids(0, 1) == [None] and a.doc_ids(1, 2) == [5] and a.bounds(1, 3).tolist() == [1, 1, 3] and a.document(2).tolist() == [2, 3] and a.document(1).tolist() == [] and b.document(0).tolist() == [7]
    with pytest.raises(ValueError):
        list(tf.segments(b"x" * 80))


def test_words_across_files(spark, tmp_path):
    w = tf.WordEncoder(JSON)
    rnd = random.Random(9)
    texts = [random_text(rnd) for _ in range(600)]
    assert w.cuts and [x.tobytes() for x in w.encode(pa.array(texts, pa.string()))] == w._many(texts)
