import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline import kept
from strandline.operators import groups, retrieval, skew, text_index, vector_index


def reach(ids, links):
    group = {i: i for i in ids}

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        group[y] = x
    return {i: top(i) for i in ids}


def test_components(spark, monkeypatch):
    """A hub, a chain, and random links."""
    monkeypatch.setattr(skew, "SALTS", 4)
    rnd = random.Random(1)
    links = [(0, k) for k in range(1, 40)] + [(100 + k, 101 + k) for k in range(30)] + [(rnd.randrange(200, 400), rnd.randrange(200, 400)) for _ in range(120)] + [(7, 7)]
    rnd.shuffle(links)
    got = {r.id: r.group for r in groups.components(spark.createDataFrame(links, "a long, b long")).collect()}
    ids = {i for a, b in links if a != b for i in (a, b)}
    assert got == reach(ids, [x for x in links if x[0] != x[1]])
    assert groups.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_long_chains(spark, monkeypatch):
    """However long a chain of links is, and however it is dealt out, it takes no rounds."""
    n = 3000
    links = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(5, "a")
    made = []
    keep = kept.keep
    monkeypatch.setattr(kept, "keep", lambda df, name: made.append(name) or keep(df, name))
    assert [tuple(r) for r in groups.components(links).groupBy("group").count().collect()] == [(0, n + 1)]
    assert len(made) <= 3


@pytest.mark.parametrize("most", [1, 8, 1 << 20])
def test_components_in_parts(spark, monkeypatch, most):
    """Tasks that hold few links pass on stars, and rounds go on with them; ids may be strings."""
    monkeypatch.setattr(groups, "MOST_LINKS", most)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rnd = random.Random(most)
        links = [(f"é{x}" if x % 3 else f"z{x}", f"é{y}" if y % 3 else f"z{y}") for x, y in ((rnd.randrange(300), rnd.randrange(300)) for _ in range(220))] + [("a", "a"), (None, "b")]
        got = {r.id: r.group for r in groups.components(spark.createDataFrame(links, "a string, b string").repartition(4)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    links = [x for x in links if x[0] and x[0] != x[1]]
    assert got == reach({i for x in links for i in x}, links)


def test_crowded_stretches(spark, monkeypatch):
    """Stretches with many cells are dealt to several tasks, with the same groups."""
    rnd = random.Random(5)
    rows = [(k, rnd.getrandbits(9) << 20, rnd.randrange(3000)) for k in rnd.sample(range(1000), 400)]
    df = spark.createDataFrame(rows, "frame_id long, phash long, t long").repartition(3)
    want = reach([r[0] for r in rows], [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] ^ b[1]).bit_count() <= 3 and abs(a[2] - b[2]) <= 20])
    for stretches, cells in ((8, 1 << 16), (64, 10), (1, 1)):
        monkeypatch.setattr(groups, "STRETCHES", stretches)
        monkeypatch.setattr(groups, "CELLS", cells)
        assert {r.frame_id: r.group_id for r in groups.near_duplicate_groups(df, "frame_id", "phash", "t", 20).collect()} == want


def test_near_duplicate_groups(spark):
    """Single linkage over like hashes and near times, against all pairs; many copies of one hash; odd rows."""
    rnd = random.Random(3)
    base = [rnd.getrandbits(63) for _ in range(4)]
    rows = []
    for k in range(260):
        h = base[rnd.randrange(4)]
        for _ in range(rnd.randrange(4)):
            h ^= 1 << rnd.randrange(63)
        rows.append((k, h, rnd.randrange(40_000), rnd.random()))
    rows += [(1000 + k, base[0], 100_000 + 30 * k, 0.5) for k in range(80)]  # a row of frames, each near the next
    rows += [(2000, None, 5, 0.1), (2001, base[0], None, 0.1), (2002, base[1], -50, 0.2), (2003, base[1], 40, 0.3)]
    df = spark.createDataFrame(rows, "frame_id long, phash long, t long, quality double").repartition(3)
    for within in (60, 700):
        want = reach([r[0] for r in rows], [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and None not in a and None not in b and (a[1] ^ b[1]).bit_count() <= 3 and abs(a[2] - b[2]) <= within])
        out = groups.near_duplicate_groups(df, "frame_id", "phash", "t", within)
        assert out.columns == [*df.columns, "group_id"]
        got = {r.frame_id: r.group_id for r in out.collect()}
        assert got == want and 20 < len(set(want.values())) < 300
    keys = retrieval.keyframes(out, "group_id", "quality", "frame_id", 2).collect()
    best = {}
    for r in sorted(rows, key=lambda r: (-r[3], r[0])):
        best.setdefault(want[r[0]], []).append(r[0])
    assert {r.frame_id for r in keys} == {i for g in best.values() for i in g[:2]}


def texts():
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(rnd.choices(words, [1 / (1 + i) for i in range(200)], k=rnd.randrange(1, 60)))) for k in range(3000)]
    rows += [(3000 + k, "rare w0 " * (1 + k % 3)) for k in range(12)] + [(5000, ""), (5001, None), (None, "rare"), (5002, "State-of-the-ART, Ärger")]
    return rows


def test_indexed_search(spark):
    path, rows = kept.new_path(spark, "index-test"), texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text_index.append_segment(docs.filter("doc_id < 1500 OR doc_id IS NULL"), path, 0, cell=16)
    text_index.append_segment(docs.filter("doc_id >= 1500 AND doc_id < 2500"), path, 1, cell=16)
    text_index.append_segment(docs.filter("doc_id >= 2500"), path, 7, cell=16)
    text_index.append_segment(docs.filter("doc_id >= 1500 AND doc_id < 2500"), path, 1, cell=16)  # again
    plain = docs.filter("doc_id IS NOT NULL").withColumn("text", F.coalesce("text", F.lit("")))
    for query, k, few in ((["rare", "w0"], 10, True), (["w3 w150"], 7, False), (["state-of-the-art"], 5, True), (["w1"], 5000, False), (["nowhere"], 3, False), ([], 3, False)):
        s = text_index.Search(spark, path, query)
        want = [(r.doc_id, round(r.score, 6)) for r in retrieval.bm25(plain, query).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k).collect()]
        assert [(r.doc_id, round(r.score, 6)) for r in s.top(k).collect()] == want
        if few:  # fewer blocks are read than there are
            p = s.plan(k)
            assert p.first.count() + p.second.count() < p.blocks.count() / 2 or p.blocks.count() < 10
    assert text_index.Search(spark, path, ["w0"]).blocks.inputFiles()
    scan = text_index.Search(spark, path, ["w0"]).blocks.select("word", "cell")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "In(word" in scan.replace("EqualTo(word", "In(word") and "lengths" not in scan.split("ReadSchema")[1]


def test_bounds_hold(spark):
    """No document of a cell scores more than the cell's bound."""
    path = kept.new_path(spark, "index-test")
    text_index.append_segment(spark.createDataFrame(texts()[:600], "doc_id long, text string"), path, 0, cell=32)
    s = text_index.Search(spark, path, ["w0", "w1", "w5"])
    bound = {r["cell"]: r["bound"] for r in s.blocks.groupBy("cell").agg(F.sum(s.weight(F.col("most"), F.col("least"))).alias("bound")).collect()}
    scores = s.scores(s.blocks).collect()
    assert len(scores) > 300 and all(r.score <= bound[r.doc_id // 32] * (1 + text_index.ROOM) for r in scores)


def vectors(n=1500, width=32):
    rnd = np.random.default_rng(4)
    centres = rnd.normal(size=(40, width)) * 3
    return [(int(k), x.tolist(), "m1" if k % 5 else "m0") for k, x in enumerate(centres[rnd.integers(0, 40, n)] + rnd.normal(size=(n, width)))]


def test_vector_index(spark, monkeypatch):
    """Clustered vectors: a fifth of the lists hold nine of ten of the nearest; scores are exact; other models are not seen."""
    monkeypatch.setattr(vector_index, "BLOCK", 32)
    rows = vectors() + [(9001, None, "m1"), (9002, [0.0] * 32, "m1"), (9003, [float("nan")] * 32, "m1")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, model string").repartition(3)
    path = kept.new_path(spark, "vectors-test")
    vector_index.write_index(df, path, lists=20, parts=8, codes=32, same=["model"])
    assert spark.read.parquet(f"{path}/rows").count() == 1500
    queries = df.filter("vec_id % 20 = 0 OR vec_id >= 9000").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_index.search(spark, path, queries, k=20, probes=4, rerank=100, same={"model": "m1"}).cache()
    wanted = vector_index.exact(df.filter("model = 'm1'"), queries, k=20)
    r = vector_index.recall(found, wanted).first()
    assert r.queries == 75 and r.recall >= 0.9
    x = {i: np.array(v) for i, v, _ in rows if v}
    for row in found.filter("query_id < 200").collect():
        a, b = x[row.query_id], x[row.key]
        assert abs(row.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-9 and row.key % 5
    exact = {(q.query_id, q["rank"]): q.key for q in wanted.collect()}
    for q in (20, 40):
        order = sorted((i for i, v, m in rows if m == "m1" and i < 9000), key=lambda i: -(x[q] @ x[i]) / np.linalg.norm(x[i]))
        assert [exact[q, k] for k in range(1, 21)] == order[:20]
    plan = spark.read.parquet(f"{path}/rows").filter("model = 'm1' AND list IN (1, 2)").select("code")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model" in plan and "vector" not in plan.split("ReadSchema")[1]
    assert vector_index.search(spark, path, queries.limit(0)).count() == 0
    with pytest.raises(ValueError, match="codes"):
        vector_index.write_index(df, path, lists=2, parts=7)


def test_vector_index_of_many_near_rows(spark):
    """Vectors without clusters: twice as many rows as are wanted are scored exactly, and nine of ten of the nearest are among them."""
    rnd = np.random.default_rng(8)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(rnd.normal(size=(4000, 64)))], "vec_id long, embedding array<float>").repartition(3)
    path = kept.new_path(spark, "vectors-test")
    vector_index.write_index(df, path, lists=4)
    queries = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    r = vector_index.recall(vector_index.search(spark, path, queries, k=20, probes=4, rerank=40), vector_index.exact(df, queries, k=20)).first()
    assert r.queries == 80 and r.recall >= 0.9


def test_vector_index_of_copies(spark):
    """More copies of a vector than are wanted, or scored exactly: those of least key, by the index as by the scan."""
    rnd = np.random.default_rng(9)
    base = rnd.normal(size=(30, 33))
    keys = rnd.permutation(2400).tolist()
    df = spark.createDataFrame([(k, base[k % 30].tolist()) for k in keys], "vec_id long, embedding array<double>").repartition(5)
    path = kept.new_path(spark, "vectors-test")
    vector_index.write_index(df, path, lists=3, codes=16)
    queries = df.filter("vec_id < 30").select(F.col("vec_id").alias("query_id"), "embedding")
    got, want = [{(r.query_id, r["rank"]): r.key for r in x.collect()} for x in (vector_index.search(spark, path, queries, k=20, probes=3, rerank=50), vector_index.exact(df, queries, k=20))]
    assert got == want == {(q, n + 1): q + 30 * n for q in range(30) for n in range(20)}


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_blocks_of_postings(size):
    """A row for each word and cell, with its bounds, wherever batches of postings are cut."""
    import pyarrow as pa

    rows = [(0, "a", 0, 1, 2, 9), (0, "a", 0, 5, 1, 4), (0, "a", 1, 0, 1, 3), (0, "b", 1, 0, 7, 3), (1, "c", 1, 2, 1, 8), (1, "c", 1, 3, 1, 6), (1, "c", 1, 4, 5, 7)]
    kind = pa.schema([("part", pa.int32()), ("word", pa.string()), ("cell", pa.int64()), ("offset", pa.int32()), ("tf", pa.int32()), ("length", pa.int32())])
    batches = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[k : k + size], strict=True), kind.types, strict=True)], schema=kind) for k in range(0, len(rows), size)]
    got = [tuple(r.values()) for b in text_index._blocks(iter([batches[0].slice(0, 0), *batches])) for r in b.to_pylist()]
    assert got == [
        (0, "a", 0, 2, 2, 4, [1, 5], [2, 1], [9, 4]), (0, "a", 1, 1, 1, 3, [0], [1], [3]), (0, "b", 1, 1, 7, 3, [0], [7], [3]), (1, "c", 1, 3, 5, 6, [2, 3, 4], [1, 1, 5], [8, 6, 7]),
    ]
