from collections import defaultdict

import numpy as np
import pytest
from fixtures import DOCS, odd_rows, passage, shingles

from strandline.llm import minhash_dedup as m
from strandline.llm.components import components


def brute(rows, size):
    """component of each doc_id: least id that links reach."""
    sets = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            sets[r[0]].append(shingles(r[1], size))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("size", [4, 5])
def test_odd_rows(odd, size):
    rows = odd_rows()
    want = brute(rows, size)
    out = m.near_dedup(odd, shingle=size).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.n_shingles == len(shingles(r.text, size))
        if r.doc_id is not None:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
        elif r.text:
            assert (r.component_id, r.kept) == (1, False)
        else:
            assert (r.component_id, r.kept) == (None, True)


def chain(n=20):
    """Each text is near the next one, but the ends are far apart; and a base whose copies are near it, not each other."""
    words = passage(1, 60 + n * 4).split()
    rows = [(k, " ".join(words[k * 4 : k * 4 + 60]), "en", "a", 0) for k in range(n)]
    base = passage(2, 200).split()
    for k in range(30):
        w = list(base)
        for x in range(4):
            w[(k * 11 + x * 50) % 200] = f"new{k}x{x}"
        rows.append((1000 + k, " ".join(w), "en", "a", 0))
    return [*rows, (2000, " ".join(base), "en", "a", 0)]


def test_chains_and_stars(spark, monkeypatch):
    rows = chain()
    want = brute(rows, 4)
    for most_rows in (20_000, 7):
        monkeypatch.setattr(m, "ROWS", most_rows)
        monkeypatch.setattr(m, "PAIRS", most_rows)
        out = m.near_dedup(spark.createDataFrame(rows, DOCS).repartition(3), shingle=4).collect()
        assert {r.doc_id: r.component_id for r in out} == want
    assert len(set(want.values())) < len(want)


def test_empty_and_clashing(spark, none):
    assert m.near_dedup(none).count() == 0
    df = spark.createDataFrame([(1, passage(1, 30), "x", 9), (2, passage(1, 30), "y", 9)], "doc_id long, text string, kept string, id long")
    out = m.near_dedup(df)
    assert out.columns == ["doc_id", "text", "id", "n_shingles", "component_id", "kept"]
    assert {r.doc_id: r.kept for r in out.collect()} == {1: True, 2: False}
    assert m.near_dedup(df, with_text=False).columns == ["doc_id", "id", "n_shingles", "component_id", "kept"]
    assert m.near_dedup(df.select("doc_id", "text"), with_text=False).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert m.near_dedup(df.select("doc_id", "text")).columns == ["doc_id", "text", "n_shingles", "component_id", "kept"]


def test_sketches_never_lose_a_similar_pair():
    rnd = np.random.default_rng(3)
    for size in (5, 40, 200, 700, 3000):
        for _ in range(40):
            pool = rnd.integers(1, 1 << 63, size * 2, dtype=np.uint64)
            same = int(np.ceil(size * 0.8))
            a = np.unique(pool[:size])
            b = np.unique(np.concatenate([pool[:same], pool[size : size + (size - same) // 9]]))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            ones = np.bitwise_count(m.odd_sketches(a) ^ m.odd_sketches(b)).reshape(2, -1).sum(axis=1)
            if j >= 0.8:
                assert ones[0] <= m.most_ones_whole(len(a) + len(b), 0.8) or len(a) + len(b) > m.WHOLE
                assert ones[1] <= m.most_ones_bins(min(len(a), len(b)), 0.8)
    far = [np.bitwise_count(m.odd_sketches(x) ^ m.odd_sketches(y)).reshape(2, -1).sum(axis=1) for x, y in [(np.unique(rnd.integers(1, 1 << 63, 300, dtype=np.uint64)), np.unique(rnd.integers(1, 1 << 63, 300, dtype=np.uint64)))]]
    assert far[0][0] > m.most_ones_whole(600, 0.8) and far[0][1] > m.most_ones_bins(300, 0.8)


def test_components(spark):
    import random

    rnd = random.Random(5)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(50)] + [(5000, 6000 + k) for k in range(100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.id: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
