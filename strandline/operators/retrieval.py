"""Extensions: retrieval over frames, texts and vectors. Where the data hold no answer, the answer is null."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.scope import scoped


def visible(df: DataFrame, owner: str | None) -> DataFrame:
    """What a channel of retrieval may see: with the column ``owner``, rows of the session's owner only (see ``scope``)."""
    return df if owner is None else scoped(df, owner)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_topk(vectors: DataFrame, query: list[float], k: int, vector: str = "embedding", tie: str = "vec_id", same: dict[str, object] | None = None, owner: str | None = None) -> DataFrame:
    """The k rows most similar to ``query``; ``same`` are hard equalities such as model and version. Vectors of texts make
    this the semantic search of texts."""
    vectors = visible(vectors, owner)
    for name, value in (same or {}).items():
        vectors = vectors.filter(F.col(name) == value)
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("score", cosine(F.col(vector), q)).orderBy(F.desc("score"), tie).limit(k)


def tokenise(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def query_words(df: DataFrame, query: list[str]) -> list[str]:
    """The distinct words of a query's strings, cut by Spark as texts are."""
    row = df.sparkSession.range(1).select(F.array_distinct(F.flatten(F.array(*[tokenise(F.lit(q)) for q in query] or [F.array().cast("array<string>")]))))
    return row.first()[0]


def bm25(docs: DataFrame, query: list[str], doc_id: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, owner: str | None = None) -> DataFrame:
    """(doc_id, score) of documents with a query word; words, also those of the query's strings, are those of ``tokenise``.

    All texts are read for their length, which counts words without making them; only texts that contain the
    letters of a query word are cut into words.
    """
    words = query_words(docs, query)
    if not words:
        return docs.filter(F.lit(False)).select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("score"))
    lower = F.lower(F.col(text))
    docs = visible(docs, owner)
    totals = docs.agg(F.count("*").alias("n"), F.avg(F.regexp_count(lower, F.lit("[\\p{L}\\p{N}]+"))).alias("average"))  # one row
    likely = reduce(lambda p, q: p | q, [F.contains(lower, F.lit(w)) for w in words])
    x = docs.filter(likely).select(F.col(doc_id).alias("doc_id"), tokenise(F.col(text)).alias("words")).withColumn("length", F.size("words"))
    hits = x.select("doc_id", "length", F.explode(F.filter("words", lambda w: w.isin(words))).alias("word")).groupBy("doc_id", "length", "word").agg(F.count("*").alias("tf"))
    df = hits.groupBy("word").agg(F.count("*").alias("df"))
    scored = hits.join(F.broadcast(df), "word").crossJoin(F.broadcast(totals))  # one row for each query word, and one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
    return scored.groupBy("doc_id").agg(F.sum(idf * weight).alias("score"))


def scenes(df: DataFrame, by: list[str], time: str, order: list[str], gap: int) -> DataFrame:
    """``df`` and scene: a number that rises where the previous row of the group is more than ``gap`` before."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce(F.col(time) - F.lag(time).over(w) > gap, F.lit(True))
    return df.withColumn("__new", new).withColumn("scene", F.count_if(F.col("__new")).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def scene_ranges(df: DataFrame, by: list[str], time: str, order: list[str], gap: int) -> DataFrame:
    return scenes(df, by, time, order, gap).groupBy(*by, "scene").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("frames"))


def neighbours(hits: DataFrame, frames: DataFrame, by: str, time: str, within: int, hit_id: str = "hit_id", owner: str | None = None) -> DataFrame:
    """(hit_id, frame columns) of frames at most ``within`` before or after a hit: an equi-join on buckets of time."""
    hits, frames = (visible(hits, owner) if owner in hits.columns else hits), visible(frames, owner)
    bucket = lambda t: F.floor(t / within)
    h = hits.select(F.col(hit_id).alias("hit_id"), F.col(by).alias("__by"), F.col(time).alias("__at"), F.explode(F.array(*[bucket(F.col(time)) + d for d in (-1, 0, 1)])).alias("__bucket"))
    f = frames.withColumn("__frame_bucket", bucket(F.col(time)))
    near = f.join(h, (f[by] == h["__by"]) & (F.col("__frame_bucket") == F.col("__bucket")) & (F.abs(F.col(time) - F.col("__at")) <= within))
    return near.drop("__by", "__at", "__bucket", "__frame_bucket")


def fuse(channels: dict[str, DataFrame], key: str = "frame_id", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of channels (key, rank): (key, score, channels)."""
    parts = [df.select(key, (1 / (F.lit(k) + F.col("rank"))).alias("part"), F.lit(name).alias("channel")) for name, df in channels.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy(key).agg(F.sum("part").alias("score"), F.array_sort(F.collect_set("channel")).alias("channels"))


def first_last_seen(sightings: DataFrame, by: str, time: str, least: float | None = None, score: str = "score") -> DataFrame:
    """For each object its first and last sighting; later rows never move the first."""
    x = sightings if least is None else sightings.filter(F.col(score) >= least)
    return x.groupBy(by).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"), F.count("*").alias("sightings"))


def last_episode(hits: DataFrame, by: str, time: str, order: list[str], gap: int) -> DataFrame:
    """For each object the last scene with a hit."""
    ranges = scene_ranges(hits, [by], time, order, gap)
    return ranges.groupBy(by).agg(F.max_by(F.struct("start", "end", "frames"), F.struct("end", "scene")).alias("e")).select(by, "e.*")


def earliest_cluster(hits: DataFrame, by: str, time: str, order: list[str], gap: int, least: float, score: str = "score", needed: int = 1) -> DataFrame:
    """For each object the earliest scene with at least ``needed`` hits of ``least`` or more; no row if there is none."""
    ranges = scene_ranges(hits.filter(F.col(score) >= least), [by], time, order, gap).filter(F.col("frames") >= needed)
    return ranges.groupBy(by).agg(F.min_by(F.struct("start", "end", "frames"), F.struct("start", "scene")).alias("e")).select(by, "e.*")


def sequence_pattern(events: DataFrame, by: str, kind: str, order: list[str], pattern: list[str]) -> DataFrame:
    """Rows at which ``pattern`` begins as consecutive kinds within the group."""
    w = Window.partitionBy(by).orderBy(*order)
    found = F.array(*[F.col(kind) if k == 0 else F.lead(kind, k).over(w) for k in range(len(pattern))])
    return events.withColumn("__found", found).filter(F.col("__found") == F.array(*[F.lit(p) for p in pattern])).drop("__found")


def keyframes(frames: DataFrame, cluster: str, quality: str, tie: str, k: int = 3) -> DataFrame:
    w = Window.partitionBy(cluster).orderBy(F.desc(quality), tie)
    return frames.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= k).drop("__n")


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit perceptual hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def similar_hashes(frames: DataFrame, frame_id: str = "frame_id", hash_: str = "phash", most: int = 3) -> DataFrame:
    """(a, b, distance) of frames whose hashes differ in ``most`` bits or fewer (3 at most).

    Of six parts at least three are equal then: an equi-join on any three of them, 31 bits or more, finds every pair, and
    few others: n hashes that spread well meet n * n / 2**33 times in each of the 20 joins. Frames with one hash are
    taken as one, the least id, so that copies do not multiply.
    """
    if most > 3:
        raise ValueError("six parts find pairs of up to 3 differing bits")
    x = frames.groupBy(F.col(hash_).alias("h")).agg(F.min(frame_id).alias("id"))
    ends = [0, 11, 22, 33, 44, 54, 64]
    masks = [((1 << q) - (1 << p)) for p, q in zip(ends[:-1], ends[1:], strict=True)]
    three = [sum(c) for c in combinations(masks, 3)]
    signed = [m - (1 << 64) if m >> 63 else m for m in three]
    parts = x.select("id", "h", F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("k", "part"))
    a, b = [parts.select("k", "part", F.col("id").alias(n), F.col("h").alias(f"h{n}")) for n in "ab"]
    return a.join(b, ["k", "part"]).filter("a < b").select("a", "b", hamming(F.col("ha"), F.col("hb")).alias("distance")).filter(F.col("distance") <= most).distinct()


def content_groups(docs: DataFrame, content: str, key: str) -> DataFrame:
    """Groups of equal contents: hash, number, and least key."""
    return docs.groupBy(F.sha2(content, 256).alias("sha256")).agg(F.count("*").alias("n"), F.min(key).alias("first"))


def recall_at(ranked: DataFrame, relevant: DataFrame, k: list[int], query: str = "query_id", item: str = "item_id") -> DataFrame:
    """Share of queries with a relevant item among the first k."""
    best = ranked.join(relevant, [query, item], "left_semi").groupBy(query).agg(F.min("rank").alias("best"))
    every = relevant.select(query).distinct().join(best, query, "left")
    return every.agg(*[F.avg(F.coalesce(F.col("best") <= n, F.lit(False)).cast("double")).alias(f"recall_{n}") for n in k])


def episode_text(rows: DataFrame, by: str, order: list[str], text: str) -> DataFrame:
    """The distinct texts of each episode, in the order in which they first appear."""
    first = rows.groupBy(by, text).agg(F.min(F.struct(*order)).alias("at"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", text))), lambda x: x[text]).alias("texts"))


def answer(df: DataFrame, least: float, score: str = "score") -> DataFrame:
    """basis: fact from ``least`` on, hypothesis below it, insufficient_data without a score."""
    return df.withColumn("basis", F.when(F.col(score).isNull(), "insufficient_data").when(F.col(score) >= least, "fact").otherwise("hypothesis"))


def quality_score(mean: Column, variance: Column) -> Column:
    """0 to 1 from the luma of a frame: flat (blurred, covered) and very dark or bright frames score low."""
    contrast = F.least(variance / 400.0, F.lit(1.0))
    return contrast * (1 - F.abs(mean - 127.5) / 127.5)


def indexed(frames: DataFrame, least: float = 0.1, all_frames: bool = False) -> DataFrame:
    """Frames (mean, variance) with their quality; those below ``least`` are left out of the index unless asked for, and stay
    where they are stored."""
    x = frames.withColumn("quality", quality_score(F.col("mean"), F.col("variance")))
    return x if all_frames else x.filter(F.col("quality") >= least)
