from pyspark.sql import functions as F

from strandline.operators import retrieval as r


def test_similar_hashes_finds_all_pairs(spark):
    import random

    rnd = random.Random(1)
    base = [rnd.getrandbits(63) for _ in range(30)]
    hashes = base + [b ^ (1 << rnd.randrange(63)) ^ (1 << rnd.randrange(63)) for b in base]
    got = {(x.a, x.b) for x in r.similar_hashes(spark.createDataFrame(list(enumerate(hashes)), "frame_id long, phash long")).collect()}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if (hashes[i] ^ hashes[j]).bit_count() <= 3}
    assert got == want and want


def test_keyframes_fuse_recall(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.9), (1, 3, 0.9), (2, 4, 0.1)], "c long, id long, q double")
    assert sorted(x.id for x in r.keyframes(df, "c", "q", "id", 2).collect()) == [2, 3, 4]
    a, b = [spark.createDataFrame(v, "frame_id long, rank long") for v in ([(1, 1), (2, 2)], [(2, 1)])]
    assert r.fuse({"a": a, "b": b}).orderBy(F.desc("score")).first().frame_id == 2
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 7)], "query_id long, item_id long, rank long")
    rel = spark.createDataFrame([(1, 11), (2, 12), (3, 13)], "query_id long, item_id long")
    got = r.recall_at(ranked, rel, [1, 5, 10]).first()
    assert [round(x, 3) for x in got] == [0.0, 0.333, 0.667]


def test_episodes(spark):
    rows = [("o", t, k, s) for k, (t, s) in enumerate([(0, 0.9), (5, 0.2), (100, 0.9), (101, 0.9), (300, 0.95)])]
    df = spark.createDataFrame(rows, "o string, t long, n long, score double")
    assert tuple(r.last_episode(df, "o", "t", ["t", "n"], 50).first()) == ("o", 300, 300, 1)
    assert tuple(r.earliest_cluster(df, "o", "t", ["t", "n"], 50, 0.9, needed=2).first()) == ("o", 100, 101, 2)
    assert r.earliest_cluster(df, "o", "t", ["t", "n"], 50, 0.99).count() == 0
    assert {x.basis for x in r.answer(df, 0.9).collect()} == {"fact", "hypothesis"}
    texts = spark.createDataFrame([("e", 2, "b"), ("e", 1, "a"), ("e", 3, "a")], "e string, t long, text string")
    assert r.episode_text(texts, "e", ["t"], "text").first().texts == ["a", "b"]


def test_neighbours_at_edges(spark):
    hits = spark.createDataFrame([(1, "u", 1000)], "hit_id long, u string, t long")
    frames = spark.createDataFrame([("u", t) for t in (899, 900, 1000, 1100, 1101)] + [("v", 1000)], "u string, t long")
    assert sorted(x.t for x in r.neighbours(hits, frames, "u", "t", 100).collect()) == [900, 1000, 1100]


def test_every_channel_is_scoped(spark):
    from strandline.operators import scope

    scope.declare(spark, "owner")
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "o"), (2, [1.0, 0.1], "p")], "vec_id long, embedding array<double>, owner_id string")
    texts = spark.createDataFrame([(1, "a bird", "o"), (2, "a bird", "p")], "doc_id long, text string, owner_id string")
    hits = spark.createDataFrame([(1, "u", 5, "o")], "hit_id long, u string, t long, owner_id string")
    frames = spark.createDataFrame([("u", 5, "o", 1), ("u", 6, "p", 2)], "u string, t long, owner_id string, n long")
    for owner, want in ((None, []), ("o", [1]), ("p", [2])):
        scope.set_owner(spark, owner)
        assert [x.vec_id for x in r.vector_topk(vectors, [1.0, 0.0], 5, owner="owner_id").collect()] == want
        assert [x.doc_id for x in r.bm25(texts, ["bird"], owner="owner_id").collect()] == want
    scope.set_owner(spark, "o")
    assert [x.n for x in r.neighbours(hits, frames.withColumnRenamed("owner_id", "frame_owner"), "u", "t", 10, owner="frame_owner").collect()] == [1]


def test_bm25_counts_words_not_letters(spark):
    docs = spark.createDataFrame([(1, "bird birds"), (2, "Bird, bird!"), (3, "thunderbird"), (4, None)], "doc_id long, text string")
    assert sorted(x.doc_id for x in r.bm25(docs, ["Bird"]).collect()) == [1, 2]


def test_flat_frames_are_not_indexed(spark):
    df = spark.createDataFrame([(1, 128.0, 900.0), (2, 128.0, 1.0), (3, 2.0, 900.0)], "id long, mean double, variance double")
    assert [x.id for x in r.indexed(df).collect()] == [1] and r.indexed(df, all_frames=True).count() == 3
