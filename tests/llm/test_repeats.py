import hashlib
from collections import Counter

import numpy as np
import pytest
from fixtures import DOCS, covered_bytes, covered_words, odd_rows, passage

from strandline.llm import bloom, repeats
import strandline.llm.suffix_dedup as suffix_dedup_module
from strandline.llm import textbytes as tb
from strandline.llm.substring_dedup import SuperKmers
from strandline.llm.substring_dedup import spec as word_spec
from strandline.llm.substring_dedup import substring_dedup
from strandline.llm.suffix_dedup import spec as byte_spec
from strandline.llm.suffix_dedup import suffix_dedup


def check_words(df, rows, window):
    want = Counter((r[0], n, g, hashlib.sha256(k).hexdigest(), k.decode()) for r, (n, g, k) in zip(rows, covered_words(rows, window), strict=True))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in df.collect()) == want


def check_bytes(df, rows, length):
    want = Counter((r[0], n, g, s, hashlib.sha256(k).hexdigest(), k) for r, (n, g, s, k) in zip(rows, covered_bytes(rows, length), strict=True))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in df.collect()) == want


@pytest.mark.parametrize("window, minimiser", [(35, 8), (10, 2), (9, 9)])
def test_odd_rows_words(odd, window, minimiser):
    check_words(substring_dedup(odd, window=window, minimiser=minimiser), odd_rows(), window)


@pytest.mark.parametrize("length", [400, 50, 17])
def test_odd_rows_bytes(odd, length):
    check_bytes(suffix_dedup(odd, length=length), odd_rows(), length)


def hot_rows():
    """A passage that stands, with other neighbours, in most texts; and copies."""
    common = passage(3, 50)
    return [(k, f"{passage(100 + k, 40)} {common} {passage(500 + k, 37)}", "en", "a", 0) for k in range(60)] + [(100 + k, passage(4, 80), "en", "a", 0) for k in range(30)]


def test_hot_keys_are_dealt_out_twice(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 3)
    rows = hot_rows()
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    check_words(substring_dedup(df), rows, 35)
    check_bytes(suffix_dedup(df, length=200), rows, 200)


class Held:
    """Stands for a broadcast value."""

    def __init__(self, value):
        self.value = value


def packed(rows, unit):
    """Batches of three rows (key, uid, start, packed), sorted by key."""
    import pyarrow as pa

    for k in range(0, len(rows), 3):
        columns = list(zip(*rows[k : k + 3], strict=True))
        yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.binary())], names=["key", "uid", "start", "packed"])


@pytest.mark.parametrize("unit", ["word", "byte"])
@pytest.mark.parametrize("most", [1, 60, 1 << 19])
def test_small_runs_of_strings(monkeypatch, unit, most):
    """However few bytes are sorted at once, one key's strings meet; equal strings, and strings that repeat themselves, too."""
    monkeypatch.setattr(repeats, "SORTED", most)
    x = repeats.Spec(unit, 4, 2, 2)
    texts = [b"a b c d e f", b"z a b c d e", b"a b c d e f", b"q q q q q q q", b"ore here per se", b"a b c d"]
    own_letters = {1: bytes.maketrans(b"", b""), 2: bytes.maketrans(b"abqer", b"ABQER"), 3: bytes.maketrans(b"abqer", b"12345")}  # equal windows have one key
    rows = sorted((key, 10 * key + k, 7 * k, t.translate(own_letters[key])) for key in (1, 2, 3) for k, t in enumerate(texts[: 3 + key]))
    want = set()
    for key in (1, 2, 3):
        own = [(u, s, t.split() if unit == "word" else [bytes([c]) for c in t]) for k2, u, s, t in rows if k2 == key]
        n = Counter(tuple(w[i : i + 4]) for _, _, w in own for i in range(len(w) - 3))
        want |= {(u, s + i) for u, s, w in own for i in range(len(w) - 3) if n[tuple(w[i : i + 4])] > 1}
    got = Counter()
    for batch in repeats._sorted_windows(x)(packed(rows, unit)):
        for r in batch.to_pylist():
            got.update((r["uid"], k) for k in range(r["s"], r["e"]))
    assert set(got) == want and set(got.values()) <= {1}


@pytest.mark.parametrize("unit", ["word", "byte"])
def test_windows_marked_by_chance_are_taken_back(unit):
    """With filters that let everything pass, what is taken back are the windows that are found once."""
    import pyarrow as pa

    x = repeats.Spec(unit, 4, 2, 2)
    search = SuperKmers(x)
    texts = [b"a b  c d e f", b"z a b\tc d e", b"q q q q q q q", b"ore here per se"]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    text, marks = search.marks(repeats.Units(x, data, at))
    column = repeats.write_marks(marks, np.searchsorted(text, np.arange(len(texts) + 1)))
    batch = pa.record_batch([pa.array([5, 6, 7, 8], pa.int64()), pa.array(texts, pa.binary()), column], names=["uid", "__text", "marks"])
    everything = Held(b"\xff" * 1024)
    run = repeats._hot_marks(x, lambda uids, m: np.ones(len(m), bool), everything, everything)
    rows = [r for b in run(iter([batch])) for r in b.to_pylist()]
    marked = {(r["uid"], k) for r in rows if r["digest"] is None for k in range(r["s"], r["e"])}
    once = {(r["uid"], r["s"]) for r in rows if r["digest"] is not None and r["n"] == 1}
    units = {u: (t.split() if unit == "word" else [bytes([c]) for c in t]) for u, t in zip((5, 6, 7, 8), texts, strict=True)}
    n = Counter(tuple(w[i : i + 4]) for w in units.values() for i in range(len(w) - 3))
    assert marked == {(u, i) for u, w in units.items() for i in range(len(w) - 3)}
    assert marked - once == {(u, i) for u, w in units.items() for i in range(len(w) - 3) if n[tuple(w[i : i + 4])] > 1}
    prints = [r for b in repeats._hot_prints(x, lambda uids, m: np.ones(len(m), bool), everything)(iter([batch])) for r in b.to_pylist()]
    assert sum(r["n"] for r in prints) == sum(n.values())


def test_long_texts(spark):
    """A text of several MB, which repeats itself here and there and has a copy of a part elsewhere."""
    rnd = np.random.default_rng(12)
    long = rnd.integers(97, 123, 3_000_000).astype(np.uint8)
    long[rnd.random(len(long)) < 0.15] = 32
    long[2_000_000:2_000_700] = long[1_000_000:1_000_700]
    text = long.tobytes().decode()
    part = "x" * 50 + text[500_000:500_900] + "y" * 50
    docs = spark.createDataFrame([(1, text), (2, part)], "doc_id long, text string")
    a, b = suffix_dedup(docs).orderBy("doc_id").collect()
    # neighbours may agree by chance, by a byte or two
    assert 2 * 700 + 900 <= a.n_removed <= 2 * 704 + 904 and a.n_spans == 3 and 900 <= b.n_removed <= 904 and b.n_spans == 1
    assert len(a.kept) == len(text) - a.n_removed
    a, b = substring_dedup(docs).orderBy("doc_id").collect()
    assert a.n_spans == 3 and b.n_spans == 1 and a.n_words == len(text.split())


def test_equal_fingerprints_are_told_apart(monkeypatch):
    monkeypatch.setattr(tb, "fixed_spans", lambda prefix, length: np.zeros(max(0, len(prefix) - length), np.uint64))
    row, v, group, _ = repeats.repeated_windows(repeats.Spec("byte", 3, 2, 2), np.frombuffer(b"abcabdabc", np.uint8), np.array([0, 6, 9]))
    assert [group[k] for k in range(len(v))] == [0, 1, 2, 3, 0]


def test_empty_and_clashing(spark, none):
    assert substring_dedup(none).count() == 0 and suffix_dedup(none).count() == 0
    rows = [(1, passage(1, 50), "h", 5), (2, passage(1, 50), "h", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_sha256 string, n_words long")
    out = substring_dedup(df)
    assert out.columns == ["doc_id", "text", "kept_sha256", "n_words", "n_removed", "n_spans"]
    assert [(r.n_words, r.n_removed, r.text) for r in out.collect()] == [(50, 50, ""), (50, 50, "")]
    df = spark.createDataFrame(rows, "uid long, text string, h string, ranges long")
    assert suffix_dedup(df, length=50).columns == ["uid", "h", "ranges", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    assert suffix_dedup(df.select("text"), length=50).count() == 2


def test_specs():
    for length in (8, 17, 50, 400, 1000):
        x = byte_spec(length)
        assert suffix_dedup_module.span(x) >= 2 * x.reach  # two phrases fit, so each string has a first pair
    assert word_spec().reach == 28
    with pytest.raises(ValueError):
        word_spec(5, 6)
    with pytest.raises(ValueError):
        byte_spec(7)


def test_each_round_ranks_longer_prefixes(spark, monkeypatch):
    """Positions left after r rounds have prefixes of as many phrases as fit, up to 2 ** r, in common with others."""
    x = byte_spec(100)
    rows = [(1, passage(1, 60)), (2, passage(1, 22) + passage(2, 60)), (3, passage(1, 30) + passage(3, 60)), (4, "ab" * 400)]
    left = {}
    for rounds in (1, 2, 3, 4):
        monkeypatch.setattr(suffix_dedup_module, "ROUNDS", rounds)
        search = suffix_dedup_module.Doubling(x)
        data = "".join(t for _, t in rows).encode()
        at = np.concatenate(([0], np.cumsum([len(t) for _, t in rows])))
        text, marks = search.marks(repeats.Units(x, np.frombuffer(data, np.uint8), at))
        places = np.searchsorted(text, np.arange(len(rows) + 1))
        column = repeats.write_marks(marks, places).to_pylist()
        marked = spark.createDataFrame([(k + 1, bytearray(m)) for k, m in enumerate(column)], "uid long, marks binary")
        pick, _ = search.refine(marked)
        left[rounds] = set(np.flatnonzero((marks["windows"] > 0) & pick(text + 1, marks)).tolist())
        a = at[text] + marks["place"]
        many = np.minimum(marks["m"], 1 << rounds)
        n = Counter((y, data[b:e]) for y, b, e in zip(many.tolist(), a.tolist(), a[np.arange(len(a)) + many].tolist(), strict=True))
        want = {k for k, (y, b, e, w) in enumerate(zip(many.tolist(), a.tolist(), a[np.arange(len(a)) + many].tolist(), marks["windows"].tolist(), strict=True)) if w and n[y, data[b:e]] > 1}
        assert left[rounds] <= want and len(want - left[rounds]) <= 4  # names look up to 15 bytes beyond the last phrase
    assert left[4] < left[1]


def test_bloom(spark):
    keys = tb.mix(np.arange(2000, dtype=np.uint64))
    df = spark.createDataFrame([(int(k),) for k in keys.view(np.int64)], "k long")
    f = bloom.build(df, "k", 2000)
    assert bloom.passes(f, keys).all()
    assert bloom.passes(f, tb.mix(np.arange(5000, 100_000, dtype=np.uint64))).mean() < 0.01
    assert not bloom.passes(bloom.build(df.limit(0), "k", 0), keys).any()


def test_real_rows(spark):
    from compare import DATA

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(150)
    rows = [tuple(r) for r in docs.collect()]
    check_words(substring_dedup(spark.createDataFrame(rows, docs.schema)), rows, 35)
    check_bytes(suffix_dedup(spark.createDataFrame(rows, docs.schema)), rows, 400)


def test_planted_passages(spark):
    """Passages that several documents share: of 80 words both operators cut them, of 55 words (less than 400 bytes) only the
    one that counts in words; clean documents are left alone by both."""
    rnd = np.random.default_rng(17)

    def prose(n):
        return " ".join(f"w{x}" for x in rnd.integers(1000, 100_000, n))

    planted = {0: prose(80), 1: prose(55), 2: ""}
    rows = [(k, f"{prose(60)} {planted[k % 3]} {prose(60)}") for k in range(45)]
    assert len(planted[1]) < 390 and len(planted[0]) > 400
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    by_words = {r.doc_id % 3: set() for r in docs.collect()}
    by_bytes = {k: set() for k in by_words}
    for r in substring_dedup(docs, with_text=False).collect():
        by_words[r.doc_id % 3].add(r.n_removed)
    for r in suffix_dedup(docs, with_text=False).collect():
        by_bytes[r.doc_id % 3].add(r.n_removed > 0)
    assert by_words == {0: {80}, 1: {55}, 2: {0}}
    assert by_bytes == {0: {True}, 1: {False}, 2: {False}}
