"""Registered queries over stored indexes and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import kept
from strandline.operators import definitions, distributions, groups, history, retrieval, segments, sequences, text_index, vector_index
from strandline.plans.catalogue import HOUR, _attempts, _millis, _query, oracle_of
from strandline.sources import commits
from strandline.sources.readers import driver_table as table


@_query("""
WITH RECURSIVE e AS (
  SELECT event_id, epoch_us(ts) // 1000 AS t, value, ((user_id % 200) * 40503 * 65536) + (event_id % 32) * 5 AS h FROM events
), l AS (
  SELECT x.event_id AS a, y.event_id AS b FROM (SELECT *, unnest([t // 3600000 - 1, t // 3600000, t // 3600000 + 1]) AS k FROM e) x
  JOIN e y ON y.t // 3600000 = k AND abs(x.t - y.t) <= 3600000 AND bit_count(xor(x.h, y.h)) <= 3
), r(a, b) AS (
  SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), g AS (
  SELECT a AS event_id, min(b) AS group_id FROM r GROUP BY a
)
SELECT event_id, group_id, row_number() OVER (PARTITION BY group_id ORDER BY value DESC, event_id) <= 3 AS keyframe FROM g JOIN e USING (event_id)""")
def near_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames: groups of like hashes within an hour, and the three best frames of each."""
    h = (F.col("user_id") % 200) * 40503 * 65536 + F.col("event_id") % 32 * 5
    e = table(spark, sf_dir, "events").select("event_id", _millis(F.col("ts")).alias("t"), "value", h.alias("phash"))
    grouped = groups.near_duplicate_groups(e, "event_id", "phash", "t", HOUR)
    best = retrieval.keyframes(grouped, "group_id", "value", "event_id", 3).select("event_id", F.lit(True).alias("best"))
    return grouped.join(best, "event_id", "left").select("event_id", "group_id", F.coalesce("best", F.lit(False)).alias("keyframe"))


@_query("""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents), n AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM d),
h AS (SELECT doc_id, len(ws) AS l, w, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS w FROM d) WHERE w IN ('license', 'released', 'idiot', 'under', 'the') GROUP BY ALL), f AS (SELECT w, count(*) AS df FROM h GROUP BY w),
s AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))) AS score FROM h JOIN f USING (w), n GROUP BY doc_id)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, doc_id LIMIT 20""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents indexed in two segments, and the 20 best for a license's words and a rude one."""
    path, docs = kept.new_path(spark, "text-index"), table(spark, sf_dir, "documents").select("doc_id", "text")
    for segment in (0, 1):
        text_index.append_segment(docs.filter(F.col("doc_id") % 2 == segment), path, segment, cell=64)
    found = text_index.Search(spark, path, ["License, released-under the", "idiot"]).top(20)
    return found.select("doc_id", F.round("score", 6).alias("score"))


@_query("SELECT count(*) AS queries, 20 AS k, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def indexed_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one through an index, against a scan of all: nine of ten are found at least.

    These vectors are spread evenly, without clusters that lists could follow, so most lists are probed.
    """
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") * 0).alias("model"))
    path = kept.new_path(spark, "vector-index")
    vector_index.write_index(e, path, lists=16, same=["model"])
    queries = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_index.search(spark, path, queries, k=20, probes=14, same={"model": 0})
    x = vector_index.recall(found, vector_index.exact(e, queries, k=20))
    return x.select("queries", F.lit(20).alias("k"), (F.col("recall") >= 0.9).alias("enough"))


@_query("""
WITH e AS (SELECT event_id, user_id, event_type AS k, epoch_us(ts) // 1000 AS t FROM events),
m AS (
  SELECT a.event_id, a.user_id, a.t, c.t AS z FROM e a JOIN e b ON b.user_id = a.user_id AND b.k = 'click' AND b.t > a.t AND b.t <= a.t + 86400000
  JOIN e c ON c.user_id = a.user_id AND c.k = 'purchase' AND c.t > b.t AND c.t <= b.t + 172800000 WHERE a.k = 'view'
)
SELECT event_id, min(z) AS sequence_end FROM m
WHERE NOT EXISTS (SELECT 1 FROM e x WHERE x.user_id = m.user_id AND x.k = 'error' AND x.t > m.t AND x.t <= z) GROUP BY event_id""")
def gapped_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view, a click within a day and a purchase within two more, whatever is between but errors."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", _millis(F.col("ts")).alias("t"))
    out = sequences.gapped_sequences(e, "user_id", "event_type", "t", ["view", "click", "purchase"], [24 * HOUR, 48 * HOUR], breaks=["error"])
    return out.select("event_id", "sequence_end")


@_query("SELECT user_id, max(epoch_us(ts) // 1000) AS last FROM events WHERE value >= 80 GROUP BY user_id")
def backward_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each user last had a value of 80 or more: days are read from the newest back, until no one is left to find."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", _millis(F.col("ts")).alias("t"), "value")
    path = kept.new_path(spark, "history")
    history.write_history(e, path, "user_id", "t", "value", history.DAY)
    return history.History(spark, path, "user_id", "t", "value").last_seen(e.select("user_id").distinct(), 80.0)


@_query("""
SELECT o_orderkey, coalesce(n, 0) AS lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1) ON l_orderkey = o_orderkey
WHERE o_orderkey % 7 <> 0""")
def committed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines in one commit; then lines that came back are deleted, and every seventh order with them, in another."""
    root = kept.new_path(spark, "commits")
    o, l = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")  # noqa: E741
    back = l.filter("l_returnflag = 'R'").distinct()
    commits.commit(spark, root, {"orders": o, "lines": l}, 1)
    commits.commit(spark, root, {}, 2, deletes={"lines": back, "orders": o.filter("o_orderkey % 7 = 0").select("o_orderkey")})
    n = commits.read(spark, root, "lines").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return commits.read(spark, root, "orders").join(n, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("lines"))


@_query(oracle_of("motion_hysteresis"))
def segmented_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion with each session cut into days."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", _millis(F.col("ts")).alias("t"), "value")
    return segments.motion_hysteresis(e, "user_id", "t", ["t", "event_id"], 24 * HOUR, "value", 120.0, 50.0, 6 * HOUR, highest=None).select("user_id", "event_id", "moving")


@_query("""
SELECT user_id AS session_id, event_id AS ingest_seq, row_number() OVER w AS ordinal, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER w AS gap_ms
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def segmented_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordinals of requests, and gaps between them, with each session cut into days."""
    a = _attempts(spark, sf_dir).select("session_id", "ingest_seq", "request_elapsed_ms")
    x = segments.ordinals(segments.gaps(a, 24 * HOUR), "session_id", "request_elapsed_ms", ["request_elapsed_ms", "ingest_seq"], 24 * HOUR)
    return x.select("session_id", "ingest_seq", "ordinal", "gap_ms")


@_query("""
WITH x AS (SELECT o_orderkey AS k, o_orderkey % 8 AS m FROM orders)
SELECT k AS o_orderkey, v.path, v.keyword FROM x JOIN (VALUES
  (1, 'error/retryable', 'const'), (2, 'error/code', 'enum'), (3, 'error', 'additionalProperties'), (4, 'error', 'required'), (5, 'error/message', 'type'), (6, '', 'json'), (7, '', 'required'), (7, '', 'additionalProperties')
) AS v(m, path, keyword) ON v.m = x.m""")
def error_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as answers: a sound one, and one for each way in which an error can be wrong."""
    texts = [
        '{"error": {"code": "unavailable", "message": "#", "retryable": true}}', '{"error": {"code": "unavailable", "message": "#", "retryable": false}}', '{"error": {"code": "n#", "message": "", "retryable": false}}',
        '{"error": {"code": "conflict", "message": "#", "retryable": false, "more": #}}', '{"error": {"code": "conflict", "retryable": false}}', '{"error": {"code": "conflict", "message": #, "retryable": false}}', '{"error": ', '{"e#": 1}',
    ]
    raw = F.element_at(F.array(*[F.lit(x) for x in texts]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.replace(raw, F.lit("#"), F.col("o_orderkey").cast("string")).alias("document"))
    return definitions.violations(o, "document", "error").drop("document")


@_query("""
WITH f AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, l_quantity FROM lineitem
), v AS (
  SELECT l_orderkey, 'frames/' || i || '/frame_id' AS path, 'pattern' AS keyword FROM f WHERE l_partkey % 11 = 0
  UNION ALL SELECT l_orderkey, 'frames/' || i || '/byte_length', 'maximum' FROM f WHERE l_quantity > 45
  UNION ALL SELECT l_orderkey, 'frames/' || i || '/byte_length', 'minimum' FROM f WHERE l_quantity < 2
  UNION ALL SELECT l_orderkey, 'frames/' || i, 'required' FROM f WHERE l_suppkey % 7 = 0
  UNION ALL SELECT l_orderkey, 'frames/' || i || '/profile', 'anyOf' FROM f WHERE l_partkey % 5 = 0
)
SELECT l_orderkey, path, keyword FROM v""")
def manifest_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as manifests of their lines, each rule broken by lines of its own."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    id_ = F.concat(F.lpad(F.lower(F.hex("l_partkey")), 8, "0"), F.lit("-0000-4000-8000-"), F.lpad(F.hex("l_partkey"), 12, "0"))
    frame = F.struct(
        F.when(F.col("l_partkey") % 11 == 0, F.concat(F.substring(id_, 1, 35), F.lit("G"))).otherwise(F.lower(id_)).alias("frame_id"), F.lit(1).alias("request_wall_ms"),
        F.when(F.col("l_suppkey") % 7 != 0, F.sha2(F.col("l_partkey").cast("string"), 256)).alias("sha256"),
        F.when(F.col("l_quantity") > 45, 1 << 40).when(F.col("l_quantity") < 2, 0).otherwise(10).alias("byte_length"),
        F.when(F.col("l_partkey") % 5 == 0, F.struct(F.lit("p").alias("id"))).alias("profile"),
    )
    frames = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", frame.alias("frame")))), lambda x: x["frame"])
    m = l.groupBy("l_orderkey").agg(F.to_json(F.struct(frames.alias("frames"))).alias("document"))
    return definitions.violations(m, "document", "manifest").drop("document")


@_query(oracle_of("request_gap_distribution"))
def sketched_gap_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of gaps by session: sketches by day are merged, and a second pass makes them exact."""
    a = segments.gaps(_attempts(spark, sf_dir).select("session_id", "ingest_seq", "request_elapsed_ms"), 24 * HOUR)
    daily = distributions.sketches(a.withColumn("day", F.floor(F.col("request_elapsed_ms") / (24 * HOUR))), ["session_id", "day"], "gap_ms")
    found = distributions.exact(a, distributions.merged(daily, ["session_id"]), "session_id", "gap_ms", {"gap_p50": (0.5, "nearest"), "gap_p95": (0.95, "nearest"), "gap_floor95": (0.95, "floor")})
    every = a.select("session_id").distinct().join(found, "session_id", "left")
    return every.select("session_id", "gap_p50", "gap_p95", F.col("most").alias("gap_max"), "gap_floor95")
