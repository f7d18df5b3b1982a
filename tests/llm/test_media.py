import hashlib
import random
import zlib

import numpy as np
import pytest
from fixtures import DOCS, odd_rows

from strandline.llm import ogg
from strandline.llm import order_minhash as om


def slow_checksum(data):
    crc = 0
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    rnd = random.Random(1)
    for n in (0, 1, 2, 27, 300):
        data = rnd.randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 1920, 65_025, 300_000])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    media = ogg.encode(data)
    payload, size, streams = ogg.decode(media)
    assert payload[:n] == data and size == n and len(payload) % 192 == 0 and payload and not payload[n:].strip()
    assert streams[ogg.PCM].seconds(ogg.RATE) == len(payload) / ogg.RATE
    assert set(streams) == {ogg.PCM, ogg.TAG}


@pytest.mark.parametrize("n", [0, 254, 255, 256, 510, 65_024, 65_025, 65_026, 140_000])
def test_lacing(n):
    packets = [(random.Random(i).randbytes(m), i) for i, m in enumerate((3, n, 7, n, 0, n))]
    assert ogg.demultiplex(b"".join(ogg.paginate(5, packets)))[5].packets == [p for p, _ in packets]


def test_broken_pages_are_found():
    media = ogg.encode(b"some text " * 500)
    for at in range(0, len(media), 97):
        with pytest.raises(ogg.OggError):
            ogg.demultiplex(media[:at] + bytes([media[at] ^ 1]) + media[at + 1 :])
    with pytest.raises(ogg.OggError):
        ogg.demultiplex(media[:-1])
    pages = ogg.paginate(1, [(b"a", 0), (b"b" * 70_000, 1)])
    with pytest.raises(ogg.OggError):
        ogg.demultiplex(b"".join([pages[0], *pages[2:]]))
    with pytest.raises(ogg.OggError):
        ogg.demultiplex(pages[1])


def test_media_operator(odd, none, spark):
    out = ogg.read_media(ogg.media_columns(odd)).collect()
    assert len(out) == len(odd_rows())
    for r in out:
        data = (r.text or "").encode()
        padded = data + b" " * (-len(data) % 192 if data else 192)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32, r.error) == (len(data), len(padded), zlib.crc32(padded[-16:]), None)
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
    assert len({r.media_sha256 for r in out}) == len({r.text or "" for r in out})
    assert ogg.read_media(ogg.media_columns(none)).count() == 0
    df = spark.createDataFrame([(1, None), (2, bytearray(b"OggS")), (3, bytearray(ogg.encode(b"x")))], "feature long, media binary")
    got = ogg.read_media(df.withColumnRenamed("feature", "k")).collect()
    assert [(r.n_bytes, bool(r.error)) for r in sorted(got, key=lambda r: r.k)] == [(None, False), (None, True), (1, False)]
    assert ogg.read_media(df).columns.count("feature") == 1 and ogg.read_media(df.select("media")).count() == 3


def plain_fingerprints(text):
    """One text, without any packing of keys."""
    from strandline.llm import textbytes as tb

    data = np.frombuffer(text, np.uint8)
    prefix = tb.sums(tb.byte_values(data))
    n = max(len(text) - om.K + 1, min(len(text), 1))
    kmers = [int(tb.mix(tb.spans(prefix, np.array([k]), np.array([min(k + om.K, len(text))])))[0]) for k in range(n)]
    seen, slots = {}, {}
    for k, x in enumerate(kmers):
        seen[text[k : k + om.K]] = seen.get(text[k : k + om.K], -1) + 1
        e = int(tb.mix(np.array([x ^ int(tb.mix(np.array([seen[text[k : k + om.K]]], np.uint64), 3)[0])], np.uint64), 4)[0])
        slots.setdefault(e % om.SLOTS, []).append((e, k))
    out = [0] * om.SLOTS
    for s, x in slots.items():
        value = np.zeros(1, np.uint64)
        picked = sorted(k for _, k in sorted(x)[: om.TUPLE])
        for i in range(om.TUPLE):
            value = tb.mix(value ^ np.uint64(kmers[picked[i]] if i < len(picked) else 0), 10 + i)
        out[s] = int(value[0]) >> 48 | 1 << 16
    full = [s for s in range(om.SLOTS) if out[s]]
    return [out[next((f for f in full if f >= s), full[0])] & 0xFFFF if full else 0 for s in range(om.SLOTS)]


def test_fingerprints_match_a_plain_version(monkeypatch):
    texts = [(r[1] or "").encode()[:900] for r in odd_rows()]
    got = om.fingerprints(texts)
    for t, g in zip(texts, got, strict=True):
        assert g.tolist() == plain_fingerprints(t)
    monkeypatch.setattr(om, "_PLACE", 3)
    assert (om.fingerprints(texts) == got).all()
    monkeypatch.undo()
    for code, rank in ((3, 24), (30, 2), (5, 5)):  # short heads: many k-mers and elements share one, whole hashes decide
        monkeypatch.setattr(om, "_CODE", code)
        monkeypatch.setattr(om, "_RANK", rank)
        assert (om.fingerprints(texts) == got).all()


def test_long_texts_keep_their_kmers_apart():
    """A text of 1.5 MB: far more k-mers than a head of 30 bits can tell apart."""
    rnd = np.random.default_rng(8)
    text = rnd.integers(97, 123, 1_500_000).astype(np.uint8).tobytes()
    got = om.fingerprints([text])[0]
    from strandline.llm import textbytes as tb

    prefix = tb.sums(tb.byte_values(np.frombuffer(text, np.uint8)))
    kmer = tb.mix(tb.fixed_spans(prefix, om.K))
    order = np.argsort(kmer, kind="stable")
    first = np.concatenate(([True], kmer[order][1:] != kmer[order][:-1]))
    number = np.empty(len(kmer), np.int64)
    number[order] = np.arange(len(kmer)) - np.maximum.accumulate(np.where(first, np.arange(len(kmer)), 0))
    element = tb.mix(kmer ^ tb.mix(number.astype(np.uint64), 3), 4)
    for s in range(om.SLOTS):
        own = np.flatnonzero(element % np.uint64(om.SLOTS) == s)
        value = np.zeros(1, np.uint64)
        for i, k in enumerate(np.sort(own[np.argsort(element[own], kind="stable")[: om.TUPLE]])):
            value = tb.mix(value ^ kmer[k], 10 + i)
        assert int(value[0]) >> 48 == int(got[s])


def test_order_matters():
    rnd = random.Random(2)
    a = [f"w{rnd.randrange(10_000)}" for _ in range(300)]
    blocks = [a[k : k + 30] for k in range(0, 300, 30)]
    shuffled = [w for b in rnd.sample(blocks, len(blocks)) for w in b]
    f = om.fingerprints([" ".join(x).encode() for x in (a, [*a[:295], "z"], shuffled)])
    assert om.likeness(f[0], f[1]) > 0.85 > om.likeness(f[0], f[2])


@pytest.mark.parametrize("partitions", [1, 4, 9])
def test_fingerprint_operator(spark, partitions):
    rows = odd_rows()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        out = om.order_fingerprints(spark.createDataFrame(rows, DOCS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = []
    import hashlib

    for k, r in enumerate(order):
        text, following = r[1] or "", order[(k + 1) % len(order)][1] or ""
        changed = text[: len(text) - len(text) // 4] + following[: len(text) // 4]
        p = om.fingerprints([x.encode() for x in (text, changed, following)])
        want.append((r[0], len(text), hashlib.sha256(changed.encode()).hexdigest(), p[0].tobytes().hex(), p[1].tobytes().hex(), float((p[0] == p[1]).mean()), float((p[0] == p[2]).mean())))
    key = lambda r: tuple(repr(x) for x in r)
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in out]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_fingerprint_edges(spark, none):
    assert om.order_fingerprints(none).count() == 0
    df = spark.createDataFrame([(1, "abcdefgh", 5)], "doc_id long, text string, fingerprint long")
    r = om.order_fingerprints(df).collect()
    assert len(r) == 1 and r[0].near_next == 1.0 and om.order_fingerprints(df).columns == ["doc_id", *om._NAMES]
