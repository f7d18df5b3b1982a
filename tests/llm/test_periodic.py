import hashlib
import random

import numpy as np
import pytest
from fixtures import odd_rows, words

from strandline.llm import periodic


def smallest_period(w):
    """By the border of a text: how far it can be laid over itself."""
    border, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = border[k - 1]
        k += w[i] == w[k]
        border[i] = k
    return len(w) - border[-1]


def brute(w, least=6, times=4):
    """Each stretch that cannot be extended, at each lag, with its smallest period."""
    out = set()
    n = len(w)
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            end = j + p
            if j > i and end - i >= max(least, times * p) and smallest_period(w[i:end]) == p:
                out.add((i, end - i, p))
            i = max(j, i) + 1
    return sorted(out)


def found(w, least=6, times=4):
    numbers = np.array([hash(x) % 1_000_003 for x in w], np.int64) if w and not isinstance(w[0], int) else np.array(w, np.int64)
    lags = np.array([len(w) // times if len(w) >= least else 0])
    counts, _ = periodic.lag_counts(numbers, np.array([0, len(w)]), lags)
    return periodic.runs(numbers, counts, least, times)


def samples():
    rnd = random.Random(5)
    yield from ([], [1], [1] * 5, [1] * 6, [1] * 500, [1, 2] * 3, [1, 2] * 4, [1, 2, 3] * 100, [1, 1, 2] * 40 + [1, 1] * 10)
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    yield [ord(c) for c in fib[-1]]
    for _ in range(120):
        w = []
        while len(w) < rnd.choice((20, 100, 400)):
            part = [rnd.randrange(rnd.choice((2, 3, 50))) for _ in range(rnd.choice((1, 2, 3, 7, 20)))]
            w += part * rnd.choice((1, 1, 2, 4, 5, 9)) + part[: rnd.randrange(len(part) + 1)]
        yield w


@pytest.mark.parametrize(("least", "times"), [(6, 4), (1, 2), (9, 3)])
def test_runs_match_brute_force(least, times):
    n = 0
    for w in samples():
        want = brute(w, least, times)
        assert found(w, least, times) == want
        n += len(want)
    assert n > 100


def test_counts_are_those_of_all_pairs(monkeypatch):
    rnd = np.random.default_rng(3)
    sizes = [0, 1, 7, 4000, 30, 3000]
    words_ = np.concatenate([np.minimum(rnd.zipf(1.3, n), 500) for n in sizes]).astype(np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    lags = np.array(sizes) // 4
    for held in (periodic._HELD, 10):
        monkeypatch.setattr(periodic, "_HELD", held)
        counts, base = periodic.lag_counts(words_, at, lags)
        for t, n in enumerate(sizes):
            w = words_[at[t] : at[t + 1]]
            assert counts[base[t] + 1 : base[t + 1]].tolist() == [int((w[:-p] == w[p:]).sum()) for p in range(1, n // 4 + 1)]


def test_long_texts():
    """Half a million words: one word, two words by chance, and prose with a planted run; multiples of a period are not searched."""
    n = 500_000
    assert found([7] * n) == [(0, n, 1)]
    rnd = np.random.default_rng(2)
    w = np.minimum(rnd.zipf(1.4, n), 50_000).astype(np.int64)
    w[100_000:400_000] = w[100_000 + np.arange(300_000) % 70_001]
    start, length, period = max(found(w.tolist()), key=lambda r: r[1])
    assert (period, start <= 100_000, length >= 300_000) == (70_001, True, True)
    assert all(p < 60 for _, _, p in found(rnd.integers(0, 2, 60_000).tolist()))


def plain_row(doc_id, text, rewrite):
    w = words(text)
    other = rewrite(doc_id, len(w)) if rewrite else None
    w = w if other is None else [w[k] for k in other]
    r = brute(w)
    gone = {k for s, m, p in r for k in range(s + p, s + m)}
    best = sorted(r, key=lambda x: (-x[1], x[0], x[2]))[:1] or [(None, None, None)]
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in r)
    return (doc_id, len(r), *best[0], 1000 * best[0][1] // best[0][2] if r else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(), [tuple(x) for x in r], kept.decode())


NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed")


@pytest.mark.parametrize("rewrite", [None, periodic.planted])
def test_operator(spark, odd, none, rewrite):
    rows = [(r[0], r[1]) for r in odd_rows()]
    rows += [(100 + k, " \n".join(f"v{(k * 31 + i * i) % 17}" for i in range(10 * k))) for k in range(40)]
    out = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string"), rewrite=rewrite)
    assert out.columns == ["doc_id", "text", *NAMES[1:]]
    got = [tuple([tuple(x) for x in r[c]] if c == "runs" else r[c] for c in NAMES) for r in out.collect()]
    want = [plain_row(*r, rewrite) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r[1] for r in want) > 3
    thin = periodic.periodic_runs(odd.withColumnRenamed("lang", "period").withColumnRenamed("source", "runs"), with_text=False)
    assert thin.columns == ["doc_id", "runs", "n_chars", *NAMES[1:8]] and thin.count() == len(odd_rows())
    assert periodic.periodic_runs(none).count() == 0
    with pytest.raises(ValueError, match="periods"):
        periodic.periodic_runs(none, times=1)


def test_planted_words():
    """The rule, one word at a time."""
    import zlib

    seen = 0
    for i in range(300):
        n = i % 37
        h = zlib.crc32(str(i).encode())
        if h % 10 or not n:
            assert periodic.planted(i, n) is None
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert periodic.planted(i, n).tolist() == [k if k < a else a + (k - a) % p for k in range(n)]
        seen += 1
    assert seen > 10 and periodic.planted(None, 5) is None


def test_documents_match_brute_force(spark):
    from compare import DATA

    from strandline.llm.queries import op12_periodic_runs

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in NAMES[:8]) for r in op12_periodic_runs(spark, DATA).collect()}
    short = [r for r in docs if len(r.text or "") < 9000]
    assert len(got) == len(docs) and len(short) > 100
    for r in short:
        assert got[r.doc_id] == plain_row(r.doc_id, r.text, periodic.planted)[:8]


