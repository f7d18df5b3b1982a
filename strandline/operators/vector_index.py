"""Nearest vectors by cosine over a stored index: inverted lists, product-quantised residuals, exact scores for the best.

Vectors are scaled to length 1. Spark's k-means over all of them gives the lists. What is left of a vector when its list's centre is
taken away is cut into parts, of two values each unless told otherwise, and each part coded by the nearest of at most 256 code
vectors, learnt from a bounded sample. The finer the parts, the less do codes mistake the order of near rows, of which there are
the more, the more rows there are. Scores are compared to PLACES, and of equal ones the smaller key comes first, so copies of a vector
have one order whatever batch they are in.
Rows lie in partitions by the columns that must be equal (model, version) and the list, so a search reads the lists that
its queries probe, of these the codes, and of the best rows the vectors.

Queries come as a table and are worked on in blocks of BLOCK, whose vectors go to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline import kept
from strandline.operators.retrieval import cosine

#: Rows that the code vectors are learnt from (those of least hash), rounds of learning, queries of a block, and the most bytes of centres that go to all tasks.
FITTED, ROUNDS, BLOCK, MOST = 20_000, 12, 1024, 64 << 20
#: Decimals of scores that tell rows apart.
PLACES = 9


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size > 0, size, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has a length: others are near to nothing."""
    v = F.col(vector)
    return vectors.filter(v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))))


def _unit_column(vector: str):
    v = F.transform(vector, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(v, lambda x: x / size)


def learn_codes(rest: np.ndarray, parts: int, codes: int, rounds: int = ROUNDS) -> np.ndarray:
    """parts x codes x width code vectors by Lloyd's rounds, from evenly spread rows on."""
    width = rest.shape[1] // parts
    books = np.zeros((parts, codes, width))
    for m in range(parts):
        x = rest[:, m * width : (m + 1) * width]
        book = x[np.linspace(0, len(x) - 1, codes).astype(int)].copy()
        for _ in range(rounds):
            own = _nearest(x, book)
            n = np.bincount(own, minlength=codes)
            sums = np.zeros_like(book)
            np.add.at(sums, own, x)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
        books[m] = book
    return books


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(axis=1) - 2 * x @ centres.T, axis=1)


def encode(rest: np.ndarray, books: np.ndarray) -> np.ndarray:
    parts, _, width = books.shape
    return np.column_stack([_nearest(rest[:, m * width : (m + 1) * width], books[m]) for m in range(parts)]).astype(np.uint8)


def _assigned(centres: np.ndarray, books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column("__v")))
            lists = _nearest(x, centres)
            code = encode(x - centres[lists], books)
            yield pa.record_batch([batch.column("__row"), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary())], names=["__row", "list", "code"])

    return run


def write_index(vectors: DataFrame, path: str, lists: int, parts: int | None = None, codes: int = 64, key: str = "vec_id", vector: str = "embedding", same: list[str] = (), rounds: int = 10, fitted: int = FITTED) -> None:
    """Index (key, vector and the columns ``same``) below ``path``. Vectors have one length, a multiple of ``parts``: half of it by
    default, or all of it where it is odd.

    Rows without a vector, or with one of zeros or not numbers, are left out. ``fitted`` bounds the rows that code vectors are learnt
    from; the lists are learnt from all rows, and all are indexed.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, vector)
    width = rows.select(F.size(vector)).first()
    if width is None:
        raise ValueError("no vectors")
    parts = parts or (width[0] if width[0] % 2 else width[0] // 2)
    if lists * width[0] * 8 > MOST or width[0] % parts or codes > 256:
        raise ValueError("too many lists, vectors that cannot be cut into parts, or more than 256 codes")
    unit = kept.keep(rows.select(F.col(key).alias("key"), _unit_column(vector).alias("u")), "unit")  # each round of k-means reads it
    centres = np.array(KMeans(k=lists, maxIter=rounds, seed=7, initSteps=2).fit(unit.select(array_to_vector("u").alias("features"))).clusterCenters())
    sample = np.array([r[0] for r in unit.orderBy(F.xxhash64("key"), "key").limit(fitted).select("u").collect()])
    kept.drop(spark, unit)
    books = learn_codes(sample - centres[_nearest(sample, centres)], parts, min(codes, len(sample)))
    packed = rows.select(F.struct(key, F.col(vector).alias("vector"), *same).alias("__row"), F.col(vector).alias("__v"))
    out = packed.mapInArrow(_assigned(centres, books), f"__row {packed.schema['__row'].dataType.simpleString()}, list int, code binary")
    out.select("__row.*", "list", "code").withColumnRenamed(key, "key").repartition(*same, "list", F.pmod(F.xxhash64("key"), F.lit(8))).write.mode("overwrite").partitionBy(*same, "list").parquet(f"{path}/rows")
    model = [("centre", k, 0, c.tolist()) for k, c in enumerate(centres)] + [("code", k, m, books[m, k].tolist()) for m in range(parts) for k in range(books.shape[1])]
    spark.createDataFrame(model, "kind string, number int, part int, vector array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def read_model(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    rows = spark.read.parquet(f"{path}/model").orderBy("part", "number").collect()
    centres = np.array([r.vector for r in rows if r.kind == "centre"])
    codes = [r for r in rows if r.kind == "code"]
    parts = 1 + max(r.part for r in codes)
    return centres, np.array([r.vector for r in codes]).reshape(parts, len(codes) // parts, -1)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k greatest of each row; of equal ones the first."""
    n = scores.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(scores), 1))
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(scores, best, axis=1).min(axis=1)
    for row in np.flatnonzero((scores >= last[:, None]).sum(axis=1) > k).tolist():  # equal ones do not all fit
        best[row] = np.argsort(-scores[row], kind="stable")[:k]
    return best


def _coded(names: list, queries: np.ndarray, probed: np.ndarray, centres: np.ndarray, books: np.ndarray, k: int):
    """The k rows of each batch and list that are best by their codes, for each query that probes the list."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.sort_by("key")
            lists = batch.column("list").to_numpy()
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            for number in np.unique(lists).tolist():
                asking = np.flatnonzero((probed == number).any(axis=1))
                rows = np.flatnonzero(lists == number)
                if not len(asking):
                    continue
                coded = centres[number] + np.concatenate([books[m][code[rows, m]] for m in range(parts)], axis=1)
                scores = np.round(queries[asking] @ coded.T, PLACES)
                best = _best(scores, k)
                asked = np.repeat(asking, best.shape[1])
                yield pa.record_batch(
                    [pa.array([names[q] for q in asked.tolist()], pa.int64()), batch.column("key").take(pa.array(rows[best.ravel()])), pa.array(np.full(len(asked), number, np.int32)), pa.array(np.take_along_axis(scores, best, axis=1).ravel())],
                    names=["query_id", "key", "list", "near"],
                )

    return run


def _blocks(queries: DataFrame, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and unit vectors of BLOCK queries after BLOCK queries: what a task gets is bounded, however many there are."""
    names, held = [], []
    for r in _usable(queries, vector).select("query_id", F.col(vector).alias("v")).orderBy("query_id").toLocalIterator():
        names.append(r.query_id)
        held.append(r.v)
        if len(names) == BLOCK:
            yield names, _unit(np.array(held, np.float64))
            names, held = [], []
    if names:
        yield names, _unit(np.array(held, np.float64))


def _ranked(scored: DataFrame, score: str, tie: str, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(score, PLACES)), tie)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, probes: int = 8, rerank: int = 200, vector: str = "embedding", same: dict[str, object] | None = None) -> DataFrame:
    """(query_id, key, score, rank) of the rows most similar to each query (query_id, vector), by cosine, among those found.

    A query looks at the ``probes`` lists whose centres are nearest, and the ``rerank`` rows that are best by their codes are scored
    exactly. ``same`` holds columns to a value. Queries without a usable vector give no row.
    """
    centres, books = read_model(spark, path)
    rows = spark.read.parquet(f"{path}/rows")
    for name, value in (same or {}).items():
        rows = rows.filter(F.col(name) == F.lit(value))
    out = None
    for names, q in _blocks(queries, vector):
        probed = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :probes]
        wanted = rows.filter(F.col("list").isin(np.unique(probed).tolist()))
        coded = wanted.select("key", "list", "code").mapInArrow(_coded(names, q, probed, centres, books, rerank), f"query_id long, key {rows.schema['key'].dataType.simpleString()}, list int, near double")
        best = _ranked(coded, "near", "key", rerank).select("query_id", "key", "list")
        asked = spark.createDataFrame(list(zip(names, q.tolist(), strict=True)), "query_id long, q array<double>")
        exact = best.join(wanted.select("key", "list", "vector"), ["list", "key"]).join(F.broadcast(asked), "query_id").withColumn("score", cosine(F.col("vector"), F.col("q")))  # BLOCK queries
        found = _ranked(exact, "score", "key", k).select("query_id", "key", "score", "rank")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"query_id long, key {rows.schema['key'].dataType.simpleString()}, score double, rank int")


def _scored(names: list, queries: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.sort_by("key")
            scores = np.round(queries @ _unit(_matrix(batch.column("v"))).T, PLACES)
            best = _best(scores, k)
            asked = np.repeat(np.arange(len(names)), best.shape[1])
            yield pa.record_batch([pa.array([names[q] for q in asked.tolist()], pa.int64()), batch.column("key").take(pa.array(best.ravel())), pa.array(np.take_along_axis(scores, best, axis=1).ravel())], names=["query_id", "key", "score"])

    return run


def exact(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank) by a scan of all vectors, for a block of queries at a time: what recall is measured against."""
    rows = _usable(vectors, vector).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    kind = rows.schema["key"].dataType.simpleString()
    out = vectors.sparkSession.createDataFrame([], f"query_id long, key {kind}, score double, rank int")
    for names, q in _blocks(queries, vector):
        out = out.unionByName(_ranked(rows.mapInArrow(_scored(names, q, k), f"query_id long, key {kind}, score double"), "score", "key", k))
    return out


def recall(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: queries, and the share of the wanted rows that were found."""
    hit = wanted.join(found.select("query_id", "key", F.lit(1).alias("hit")), ["query_id", "key"], "left")
    return hit.agg(F.count_distinct("query_id").alias("queries"), (F.sum("hit") / F.count("*")).alias("recall"))
