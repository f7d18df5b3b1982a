"""The registered queries over the driver's tables, and their SQL.

``events`` stand for capture attempts and samples: the user is the session, ``event_id`` the order of insertion, the time of
the event the elapsed clock, and ``value`` a score or latency. Thresholds are scaled to these values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline import schemas
from strandline.functions import scalars, strict_json
from strandline.operators import jobs, manifest, motion, quality, recovery, retrieval, scope, sessions
from strandline.sources import sinks
from strandline.sources.readers import driver_table as table
from strandline.sources.readers import keyset_page
from strandline.streaming import stateful

HOUR = 3_600_000
#: Name to (query, SQL or None).
_CATALOGUE: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _CATALOGUE[f.__name__] = (f, sql)
        return f

    return add


def oracle_of(name: str) -> str | None:
    """The SQL of a query that is registered already: for another way to the same rows."""
    return _CATALOGUE[name][1]


def _parts(ts: Column, unit: int) -> Column:
    """Parts of a second since 1970 of a time without zone, whatever the session's zone is."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")
    return (days * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60) * unit + F.floor(F.extract(F.lit("SECOND"), ts) * unit).cast("long")


def _millis(ts: Column) -> Column:
    return _parts(ts, 1000)


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", _millis(F.col("ts")).alias("at"))
    result = F.when(F.col("event_type") == "error", "CAMERA_FAILURE").when(F.col("event_type") == "signup", "STORAGE_FAILURE").when(F.col("event_type") == "purchase", "INTERRUPTED").otherwise("SAVED")
    x = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("ingest_seq"), F.col("at").alias("request_elapsed_ms"), result.alias("result"), F.floor(F.col("value") * 10).cast("long").alias("latency"))
    x = sessions.gaps(x).withColumn("scheduled_due_elapsed_ms", F.col("request_elapsed_ms") - F.col("gap_ms") + 6 * HOUR).drop("gap_ms")
    return x.withColumn("disk_drained_elapsed_ms", F.col("request_elapsed_ms") + 40).withColumn("commit_complete_elapsed_ms", F.when(F.col("result") != "CAMERA_FAILURE", F.col("request_elapsed_ms") + F.col("latency")))


_A = """
WITH e AS (
  SELECT user_id AS session_id, event_id AS ingest_seq, (epoch_us(ts) // 1000) AS t, value, event_type,
    CASE event_type WHEN 'error' THEN 'CAMERA_FAILURE' WHEN 'signup' THEN 'STORAGE_FAILURE' WHEN 'purchase' THEN 'INTERRUPTED' ELSE 'SAVED' END AS result,
    floor(value * 10)::BIGINT AS latency
  FROM events
), a AS (
  SELECT *, t - lag(t) OVER w AS gap_ms, CASE WHEN t > lag(t) OVER w + 21600000 THEN t - lag(t) OVER w - 21600000 END AS late_ms,
    CASE WHEN result <> 'CAMERA_FAILURE' AND latency >= 0 THEN latency END AS pipeline_ms, CASE WHEN result = 'SAVED' AND latency >= 40 THEN latency - 40 END AS save_ms
  FROM e WINDOW w AS (PARTITION BY session_id ORDER BY t, ingest_seq)
)
"""


def _dist(df: DataFrame, *names: str) -> list[Column]:
    return [F.col(f"{n}.{p}").alias(f"{n}_{p}") for n in names for p in ("p50", "p95", "max")]


def _sql_dist(column: str, name: str) -> str:
    return f"quantile_disc({column}, 0.5) AS {name}_p50, quantile_disc({column}, 0.95) AS {name}_p95, max({column}) AS {name}_max"


@_query(_A + f"""
SELECT session_id, count(*) AS attempts, count(*) FILTER (WHERE result = 'SAVED') AS saved, count(*) FILTER (WHERE result = 'CAMERA_FAILURE') AS camera_failures,
  count(*) FILTER (WHERE result = 'STORAGE_FAILURE') AS storage_failures, count(*) FILTER (WHERE result = 'INTERRUPTED') AS interrupted,
  count(late_ms) AS overruns, max(late_ms) AS max_overrun_ms, {_sql_dist('gap_ms', 'gap')}, {_sql_dist('pipeline_ms', 'pipeline')}, {_sql_dist('save_ms', 'save')}
FROM a GROUP BY session_id""")  # fmt: skip
def session_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = sessions.attempt_facts(_attempts(spark, sf_dir))
    return facts.select("session_id", "attempts", "saved", "camera_failures", "storage_failures", "interrupted", "overruns", "max_overrun_ms", *_dist(facts, "gap", "pipeline", "save"))


@_query(_A + f"SELECT session_id, {_sql_dist('gap_ms', 'gap')}, list_sort(list(gap_ms) FILTER (WHERE gap_ms IS NOT NULL))[floor(0.95 * (count(gap_ms) - 1))::BIGINT + 1] AS gap_floor95 FROM a GROUP BY session_id")
def request_gap_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = sessions.gaps(_attempts(spark, sf_dir))
    x = gaps.groupBy("session_id").agg(sessions.distribution("gap_ms").alias("gap"))
    x = x.join(sessions.floor_ranks(gaps, "session_id", "gap_ms", 0.95, "gap_floor95"), "session_id")
    return x.select("session_id", *_dist(x, "gap"), "gap_floor95")


@_query(_A + "SELECT session_id, count(late_ms) AS overruns, max(late_ms) AS max_overrun_ms FROM a GROUP BY session_id")
def overrun_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.attempt_facts(_attempts(spark, sf_dir)).select("session_id", "overruns", "max_overrun_ms")


@_query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def latest_per_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as telemetry: clicks are START, purchases END; battery level from the value, a scale of 100."""
    level = F.floor(F.least(F.col("value"), F.lit(120.0))).cast("int")
    reason = F.when(F.col("event_type") == "click", "START").when(F.col("event_type") == "purchase", "END").otherwise("PERIODIC")
    b = scalars.battery(level, F.lit(100))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("sample_id"), _millis(F.col("ts")).alias("elapsed_ms"), reason.alias("reason"), b["level"].alias("battery_level"), b["scale"].alias("battery_scale"), b["percent"].alias("battery_percent"),
        F.lit(sessions.DISCHARGING).alias("battery_status"), F.when(F.col("user_id") % 3 == 0, 0).otherwise((F.col("event_id") % 2).cast("int")).alias("battery_plugged"),
        (F.col("event_id") % 400).cast("int").alias("battery_temperature_tenths_c"), F.when(F.col("event_type") == "error", F.lit(2)).alias("thermal_status"), (F.col("event_id") * 1000).alias("public_free_bytes"), F.lit(None).cast("long").alias("private_free_bytes"),
    )


_S = """
WITH s AS (
  SELECT user_id AS session_id, event_id AS sample_id, (epoch_us(ts) // 1000) AS t, CASE event_type WHEN 'click' THEN 'START' WHEN 'purchase' THEN 'END' ELSE 'PERIODIC' END AS reason,
    CASE WHEN floor(least(value, 120.0)) BETWEEN 0 AND 100 THEN floor(least(value, 120.0))::DOUBLE END AS percent, CASE WHEN user_id % 3 = 0 THEN 0 ELSE event_id % 2 END AS plugged,
    (event_id % 400)::INTEGER AS temperature, CASE WHEN event_type = 'error' THEN 2 END AS thermal, event_id * 1000 AS free
  FROM events
), f AS (
  SELECT session_id, count(*) AS samples, max(t) AS last_sample_elapsed_ms,
    arg_min(struct_pack(p := percent, f := free), (t, sample_id)) FILTER (WHERE reason = 'START') AS a, arg_max(struct_pack(p := percent, f := free), (t, sample_id)) FILTER (WHERE reason = 'END') AS z,
    bool_and(percent IS NOT NULL AND plugged = 0) AS steady, min(temperature) AS min_temperature_tenths_c, max(temperature) AS max_temperature_tenths_c, max(thermal) AS max_thermal_status, min(free) AS public_free_min
  FROM s GROUP BY session_id
)
"""


@_query(_S + "SELECT session_id, samples, last_sample_elapsed_ms, a.p AS battery_start, z.p AS battery_end, min_temperature_tenths_c, max_temperature_tenths_c, max_thermal_status, a.f AS public_free_start, z.f AS public_free_end, public_free_min FROM f")
def first_last_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sample_facts(_samples(spark, sf_dir)).select("session_id", "samples", "last_sample_elapsed_ms", "battery_start", "battery_end", "min_temperature_tenths_c", "max_temperature_tenths_c", "max_thermal_status", "public_free_start", "public_free_end", "public_free_min")


@_query(_S + "SELECT session_id, steady, CASE WHEN steady THEN z.p - a.p END AS battery_delta FROM f")
def uniform_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invalid sample, or one on power, breaks a session's regime."""
    return sessions.sample_facts(_samples(spark, sf_dir)).select("session_id", "steady", "battery_delta")


#: The clock of ``sample_age``: late in January 2024, before the last samples of some sessions.
NOW = 1_706_300_000_000


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user as a session: open, complete (ended 5 s after the last event) or interrupted, by turns."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(_millis(F.col("ts"))).alias("first"), F.max(_millis(F.col("ts"))).alias("last"))
    status = F.when(F.col("user_id") % 3 == 0, "OPEN").when(F.col("user_id") % 3 == 1, "COMPLETE").otherwise("INTERRUPTED")
    return e.select(F.col("user_id").alias("id"), status.alias("completion_status"), F.col("first").alias("start_elapsed_ms"), F.when(status == "COMPLETE", F.col("last") + 5000).alias("end_elapsed_ms"))


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as committed frames, clicks as pending ones."""
    e = table(spark, sf_dir, "events").filter("event_type IN ('view', 'click')")
    return e.select(F.col("user_id").alias("session_id"), F.when(F.col("event_type") == "view", 1).otherwise(0).alias("state"), (F.col("event_id") * 10).alias("bytes"), (F.col("event_id") % 3 + 1).cast("int").alias("actual_width"), (F.col("event_id") % 2 + 1).cast("int").alias("actual_height"))


@_query(_A + f"""
, x AS (SELECT session_id, CASE session_id % 3 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'COMPLETE' ELSE 'INTERRUPTED' END AS s, min(t) AS a, max(t) AS z FROM e GROUP BY session_id),
y AS (SELECT *, CASE s WHEN 'OPEN' THEN {NOW} WHEN 'COMPLETE' THEN z + 5000 END AS u FROM x),
f AS (SELECT user_id AS session_id, count(*) AS n, sum(event_id * 10) AS b FROM events WHERE event_type = 'view' GROUP BY user_id),
h AS (SELECT session_id, string_agg(w || 'x' || h || ' (' || n || ')', ', ' ORDER BY w, h) AS sizes FROM (SELECT user_id AS session_id, event_id % 3 + 1 AS w, event_id % 2 + 1 AS h, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL) GROUP BY session_id)
SELECT session_id, CASE WHEN u - a >= 0 THEN u - a END AS duration_ms, CASE WHEN u - z >= 0 THEN u - z END AS sample_age_ms, coalesce(n, 0) AS frames, coalesce(b, 0)::BIGINT AS frame_bytes, coalesce(sizes, 'unknown') AS actual_sizes
FROM y LEFT JOIN f USING (session_id) LEFT JOIN h USING (session_id)""")
def sample_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sessions.session_diagnostics(_sessions(spark, sf_dir), _samples(spark, sf_dir), _attempts(spark, sf_dir), _frames(spark, sf_dir), NOW)
    return x.select("session_id", "duration_ms", "sample_age_ms", "frames", "frame_bytes", "actual_sizes")


@_query("""
SELECT p_brand, string_agg(w || 'x' || h || ' (' || n || ')', ', ' ORDER BY w, h) AS sizes
FROM (SELECT p_brand, p_size AS w, p_size % 7 AS h, count(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand""")
def dimension_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_size", (F.col("p_size") % 7).alias("h"))
    return sessions.size_histogram(p, ["p_brand"], "p_size", "h", "sizes")


@_query("""
WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ordinal, nullif(event_type, 'error') AS k, min((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id) AS s FROM events),
y AS (SELECT *, min(ordinal) OVER (PARTITION BY user_id, k) AS f FROM x)
SELECT user_id, event_id, ordinal, CASE WHEN k IS NOT NULL THEN dense_rank() OVER (PARTITION BY user_id, k IS NULL ORDER BY f) END AS key_ordinal, (epoch_us(ts) // 1000) - s AS offset_ms FROM y""")
def report_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.nullif("event_type", F.lit("error")).alias("k"), _millis(F.col("ts")).alias("at"))
    x = sessions.first_seen_ordinals(sessions.ordinals(e, "user_id", ["ts", "event_id"]), "user_id", "k", ["ts", "event_id"])
    x = x.withColumn("start", F.min("at").over(Window.partitionBy("user_id")))
    return x.select("user_id", "event_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("key_ordinal").cast("long").alias("key_ordinal"), scalars.offset(F.col("at"), F.col("start")).alias("offset_ms"))


@_query("""
SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE NOT (o_orderdate <= l_shipdate AND CASE WHEN l_linenumber = 1 THEN true ELSE l_shipdate <= o_orderdate + INTERVAL 60 DAY END)""")
def phase_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("ship")).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("ordered")), "l_orderkey")
    x = x.withColumn("due", F.when(F.col("l_linenumber") != 1, F.date_add("ordered", 60)))
    return x.filter(~sessions.phase_order(["ordered", "ship", "due"])).select("l_orderkey", "l_linenumber")


@_query("""
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'SAVED' ELSE 'INTERRUPTED' END AS result FROM orders""")
def exists_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("frame_id"), F.when(F.col("o_orderstatus") == "O", "PENDING").otherwise(F.col("o_orderstatus")).alias("result"), F.lit(None).cast("string").alias("failure_phase"), F.lit(0).alias("commit_complete_elapsed_ms"))
    frames = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.lit(1).alias("state"))
    return sessions.recover_attempts(o, frames).select("o_orderkey", "result")


@_query("SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unknown_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return recovery.unknown_originals(docs, table(spark, sf_dir, "labels"), ["doc_id"]).select("doc_id", F.md5("text").alias("digest"))


@_query("""
SELECT 'lineitem' AS child, 'orders' AS parent, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders', 'lineitem', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'orders', 'customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'customer', 'nation', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'documents', 'labels', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def reference_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for child, c, parent, p in (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("documents", "doc_id", "labels", "doc_id")):
        n = quality.foreign_key(table(spark, sf_dir, child), [c], table(spark, sf_dir, parent), [p]).agg(F.count("*").alias("violations")).select(F.lit(child).alias("child"), F.lit(parent).alias("parent"), "violations")
        out = n if out is None else out.unionByName(n)
    return out


@_query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'unindexed' WHEN d.doc_id IS NULL THEN 'missing' WHEN strlen(text) <> known OR sha256(text) <> digest THEN 'changed' ELSE 'ok' END AS status
FROM (SELECT * FROM documents WHERE source <> 'src3') d
FULL JOIN (SELECT doc_id, n_chars AS known, sha256(CASE WHEN doc_id % 9 = 0 THEN reverse(text) ELSE text END) AS digest FROM labels JOIN documents USING (doc_id)) l ON d.doc_id = l.doc_id""")
def expected_vs_actual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files are the texts of all sources but one; the catalog has the labelled documents, with their size in characters, and of every
    ninth the hash of the text from its end: as long, but another content."""
    docs = table(spark, sf_dir, "documents")
    known = F.when(F.col("doc_id") % 9 == 0, F.reverse("text")).otherwise(F.col("text"))
    catalog = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("n_chars").cast("long").alias("bytes"), F.sha2(known, 256).alias("sha256"))
    files = docs.filter("source <> 'src3'").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    return recovery.compare_sides(files, catalog, ["doc_id"], digest="sha256")


@_query("SELECT user_id, event_id, event_type FROM events WHERE user_id > 20 OR (user_id = 20 AND event_id > 500) ORDER BY user_id, event_id LIMIT 100")
def keyset_page_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyset_page(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id", "event_id"], [20, 500])


@_query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 7")
def owner_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    scope.declare(spark, "strandline_owner", "BIGINT")
    scope.set_owner(spark, 7, "strandline_owner")
    own = scope.scoped(table(spark, sf_dir, "customer"), "c_nationkey", "strandline_owner").select("c_custkey")
    return own.join(table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@_query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 3 <> 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1) GROUP BY o_custkey")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return manifest.insert_if_absent(o.filter("o_orderkey % 3 <> 1"), o.filter("o_orderkey % 3 = 1"), ["o_custkey"], ["o_orderkey"])


#: One batch after the other: the recurring table holds the number of the batch, the contents registered so far, and all verdicts.
@_query("""
WITH RECURSIVE k AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 7),
x AS (
  SELECT l_orderkey AS batch_id, dense_rank() OVER (ORDER BY l_orderkey) AS n, l_partkey AS p, l_quantity <= 45 AS valid, l_quantity::INTEGER % 9 = 0 AS other, k.l_partkey IS NOT NULL AS known,
    count(*) OVER (PARTITION BY l_orderkey, l_partkey) > 1 AS repeated
  FROM lineitem LEFT JOIN k USING (l_partkey)
), y AS (
  SELECT batch_id, n, count(*) AS frames, CASE WHEN NOT bool_and(valid AND NOT repeated) THEN 'invalid_request' WHEN bool_or(known AND other) THEN 'conflict' END AS verdict,
    list(struct_pack(p := p, other := other) ORDER BY p) FILTER (WHERE NOT known) AS fs
  FROM x GROUP BY batch_id, n
), z AS (
  SELECT *, row_number() OVER (ORDER BY n) AS m FROM y WHERE verdict IS NULL
), r(m, registered, ok) AS (
  SELECT 0::BIGINT, MAP {}::MAP(BIGINT, BOOLEAN), true
  UNION ALL
  SELECT m, CASE WHEN ok THEN map_concat(registered, map_from_entries(coalesce(fs, []))) ELSE registered END, ok
  FROM (SELECT z.m, r.registered, z.fs, coalesce(list_bool_and(list_transform(z.fs, lambda f: coalesce(r.registered[f.p] = f.other, true))), true) AS ok FROM r JOIN z ON z.m = r.m + 1)
)
SELECT batch_id, frames, coalesce(verdict, CASE WHEN (SELECT ok FROM r WHERE r.m = z.m) THEN 'accepted' ELSE 'conflict' END) AS verdict FROM y LEFT JOIN (SELECT batch_id, m FROM z) z USING (batch_id)""")
def batch_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.batch_verdicts(_batches(spark, sf_dir), _catalog(spark, sf_dir)).groupBy("batch_id", "verdict").agg(F.count("*").alias("frames")).select("batch_id", "frames", "verdict")


def _metadata(part: Column, bytes_: Column, other: Column) -> Column:
    """Metadata of the frame that a part stands for; ``other`` contents have another hash."""
    none = F.lit(None)
    m = F.struct(_uuid(part).alias("frame_id"), F.lit(1).alias("request_wall_ms"), F.sha2(F.concat_ws("-", part, other), 256).alias("sha256"), bytes_.alias("byte_length"), *[none.alias(n) for n in ("session_id", "request_elapsed_ms", "saved_wall_ms", "capture_settings", "profile")])
    return m.cast(schemas.METADATA)


def _uuid(x: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(x)), 8, "0"), F.lit("-0000-4000-8000-000000000000"))


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches of frames, one for each line: too long from 46 pieces on, and with other contents for every ninth quantity."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    size = F.count("*").over(Window.partitionBy("l_orderkey")).cast("int")
    l = l.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").withColumn("size", size)  # noqa: E741 - beside the window, what follows would be shuffled with it
    other = F.col("l_quantity").cast("int") % 9 == 0
    return l.select(F.col("l_orderkey").alias("batch_id"), F.lit("a").alias("archive_id"), F.col("size").alias("batch_size"), ((F.col("l_linenumber").cast("long") * 100_000 + F.col("l_partkey")) * 10_000 + F.col("l_suppkey")).alias("pos"), _metadata(F.col("l_partkey"), F.when(F.col("l_quantity") <= 45, 10).otherwise(0), other).alias("metadata"))


def _catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of parts that stand seventh in an order; those of even parts are committed."""
    l = table(spark, sf_dir, "lineitem").filter("l_linenumber = 7").select("l_partkey").distinct()  # noqa: E741
    at = F.when(F.col("l_partkey") % 2 == 0, F.timestamp_seconds(F.lit(1_700_000_000) + F.col("l_partkey")))
    return l.select(F.lit("a").alias("archive_id"), _uuid(F.col("l_partkey")).alias("id"), F.lit("o").alias("owner_id"), F.lit("d").alias("registering_device_id"), _metadata(F.col("l_partkey"), F.lit(10), F.lit(False)).alias("metadata"), at.alias("committed_at"))


@_query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def content_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.content_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")


@_query("""
WITH x AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS t, value, sum(CASE WHEN value <= 50 THEN 0 ELSE 1 END) OVER w AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, min(CASE WHEN value <= 50 THEN t END) OVER (PARTITION BY user_id, run ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS since FROM x),
z AS (SELECT *, CASE WHEN value >= 120 THEN 1 WHEN value <= 50 AND t - since >= 21600000 THEN 0 END AS signal FROM y)
SELECT user_id, event_id, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0) = 1 AS moving FROM z""")
def motion_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", _millis(F.col("ts")).alias("t"), "value")
    return motion.motion_hysteresis(e, "user_id", "t", ["t", "event_id"], "value", 120.0, 50.0, 6 * HOUR, highest=None).select("user_id", "event_id", "moving")


@_query("""
WITH x AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS t, CASE WHEN value <= 30 THEN 1 WHEN value >= 90 THEN 0 END AS signal FROM events)
SELECT user_id, event_id, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0) = 1 AS cover FROM x""")
def cover_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", _millis(F.col("ts")).alias("t"), "value")
    return motion.cover_hysteresis(e, "user_id", ["t", "event_id"], "value", "value", (30.0, 30.0), (90.0, 90.0), "cover").select("user_id", "event_id", "cover")


@_query("""
WITH x AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)
SELECT vec_id, round(list_avg(v), 6) AS mean, round(list_var_pop(v), 6) AS variance, round(CASE WHEN b IS NULL THEN 0 ELSE list_avg(list_transform(list_zip(v, b), lambda p: abs(p[1] - p[2]))) END, 6) AS motion FROM x""")
def array_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("samples"))
    return motion.luma_metrics(e, "label", ["vec_id"]).select("vec_id", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "motion")])


@_query("""
WITH RECURSIVE e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) // 3600 AS t, least(value / 10, 255.0) AS score FROM events),
a AS (SELECT *, row_number() OVER w AS n, sum(CASE WHEN score <= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
b AS (SELECT *, min(CASE WHEN score <= 5 THEN t END) OVER (PARTITION BY user_id, run ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS since FROM a),
c AS (SELECT *, CASE WHEN score >= 12 THEN 1000 WHEN score <= 5 AND t - since >= 3000 THEN 2000 END AS signal FROM b),
x AS (SELECT user_id, event_id, t, n, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 2000)::BIGINT AS every FROM c),
r AS (
  SELECT user_id, event_id, n, t AS latest, true AS accepted, t AS due_ms, every AS interval_ms FROM x WHERE n = 1
  UNION ALL SELECT x.user_id, x.event_id, x.n, CASE WHEN x.t >= r.latest + x.every THEN x.t ELSE r.latest END, x.t >= r.latest + x.every, CASE WHEN x.t >= r.latest + x.every THEN r.latest + x.every END, CASE WHEN x.t >= r.latest + x.every THEN x.every END
  FROM r JOIN x ON x.user_id = r.user_id AND x.n = r.n + 1
)
SELECT user_id, event_id, accepted, due_ms, interval_ms FROM r""")
def capture_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(_millis(F.col("ts")) / 3600).alias("t"), F.least(F.col("value") / 10, F.lit(255.0)).alias("score"))
    return motion.capture_schedule(e, "user_id", "t", ["t", "event_id"]).select("user_id", "event_id", "accepted", "due_ms", "interval_ms")


@_query("""
WITH RECURSIVE x AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT user_id, event_id, n, t AS last, true AS accepted FROM x WHERE n = 1
  UNION ALL SELECT x.user_id, x.event_id, x.n, CASE WHEN x.t - r.last >= 43200000 THEN x.t ELSE r.last END, x.t - r.last >= 43200000 FROM r JOIN x ON x.user_id = r.user_id AND x.n = r.n + 1
)
SELECT user_id, event_id, accepted FROM r""")
def analysis_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", _millis(F.col("ts")).alias("t"))
    return motion.throttle(e, "user_id", "t", ["t", "event_id"], 12 * HOUR).select("user_id", "event_id", "accepted")


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', {s}, {str(r).lower()})" for c, s, r in schemas.ERRORS) + ") AS v(code, http_status, retryable)")
def error_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schemas.error_dimension(spark)


@_query("""
WITH x AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS t, event_type, value FROM events), y AS (SELECT *, last_value(CASE WHEN event_type = 'view' THEN t END IGNORE NULLS) OVER w AS seen, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS v FROM x WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, CASE WHEN t - seen <= 14400000 THEN v END AS recent FROM y WHERE event_type = 'click'""")
def latest_within_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", _millis(F.col("ts")).alias("t"), "event_type", F.when(F.col("event_type") == "view", F.col("value")).alias("v"))
    return motion.latest_within(e, "user_id", "t", ["t", "event_id"], "v", F.col("event_type") == "click", 4 * HOUR, "recent").select("user_id", "event_id", "recent")


@_query("""
SELECT c_custkey, CASE WHEN regexp_matches(c_name, '[,"\n\r]') THEN '"' || replace(c_name, '"', '""') || '"' ELSE c_name END || ',' || c_custkey || ',' || CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END || ',"a ""quoted"", value"' AS line FROM customer""")
def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", scalars.csv_line(F.col("c_name"), F.col("c_custkey"), F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")), F.lit('a "quoted", value')).alias("line"))


@_query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders")
def state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return sinks.folded(o, o.filter("o_orderkey % 5 = 0").select("o_orderkey", F.lit("F").alias("o_orderstatus")), ["o_orderkey"])


@_query("SELECT count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM labels) OR doc_id % 13 = 0) AS unknown, count(*) FILTER (WHERE doc_id % 17 = 0 AND doc_id % 13 <> 0) AS stages FROM documents WHERE doc_id % 17 <> 0 OR doc_id % 13 = 0 OR true")
def file_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda c: F.concat(F.lpad(F.hex(F.col(c)), 8, "0"), F.lit("-0000-4000-8000-000000000000"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower(ids("doc_id")).alias("id"))
    originals = d.select(F.when(F.col("doc_id") % 13 == 0, F.lit("other.bin")).otherwise(scalars.object_name(F.col("id"), F.col("id"))).alias("name"))
    stages = d.filter("doc_id % 17 = 0 AND doc_id % 13 <> 0").select(F.concat(F.lit(".stage-"), "id").alias("name"))
    known = table(spark, sf_dir, "labels").select(F.lower(ids("doc_id")).alias("id")).withColumn("archive_id", F.col("id"))
    return recovery.audit(originals.unionByName(stages), known)


@_query("""
WITH x AS (SELECT user_id, (epoch_us(ts) // 1000) AS t, event_id, CASE WHEN (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER w > 43200000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS scene FROM x)
SELECT user_id, scene, min(t) AS start, max(t) AS "end", count(*) AS frames FROM y GROUP BY user_id, scene""")
def scene_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", _millis(F.col("ts")).alias("t"))
    return retrieval.scene_ranges(e, ["user_id"], "t", ["t", "event_id"], 12 * HOUR)


@_query("""
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], [CASE WHEN i % 3 = 0 THEN 1.0 ELSE -0.5 END FOR i IN range(64)]::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], [CASE WHEN i % 3 = 0 THEN 1.0 ELSE -0.5 END FOR i IN range(64)]::DOUBLE[]) DESC, vec_id LIMIT 20""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = [1.0 if i % 3 == 0 else -0.5 for i in range(64)]
    return retrieval.vector_topk(table(spark, sf_dir, "embeddings"), query, 20).select("vec_id", F.round("score", 6).alias("score"))


@_query("""
WITH h AS (SELECT user_id, (epoch_us(ts) // 1000) AS t, event_id FROM events WHERE value >= 100), x AS (SELECT *, CASE WHEN t - lag(t) OVER w > 86400000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS scene FROM x), z AS (SELECT user_id, scene, min(t) AS start, max(t) AS "end", count(*) AS frames FROM y GROUP BY user_id, scene)
SELECT user_id, start, "end", frames FROM z WHERE frames >= 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY start, scene) = 1""")
def earliest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", _millis(F.col("ts")).alias("t"), F.col("value").alias("score"))
    return retrieval.earliest_cluster(e, "user_id", "t", ["t", "event_id"], 24 * HOUR, 100.0, needed=2)


@_query("""
WITH h AS (SELECT user_id, (epoch_us(ts) // 1000) AS t, event_id FROM events WHERE event_type = 'purchase'), x AS (SELECT *, CASE WHEN t - lag(t) OVER w > 86400000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM h WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS scene FROM x), z AS (SELECT user_id, scene, min(t) AS start, max(t) AS "end", count(*) AS frames FROM y GROUP BY user_id, scene)
SELECT user_id, start, "end", frames FROM z QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY "end" DESC, scene DESC) = 1""")
def last_episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "event_id", _millis(F.col("ts")).alias("t"))
    return retrieval.last_episode(e, "user_id", "t", ["t", "event_id"], 24 * HOUR)


@_query("""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents), n AS (SELECT count(*) AS n, avg(len(ws)) AS a FROM d),
h AS (SELECT doc_id, len(ws) AS l, w, count(*) AS tf FROM (SELECT doc_id, ws, unnest(ws) AS w FROM d) WHERE w IN ('license', 'released', 'idiot') GROUP BY ALL), f AS (SELECT w, count(*) AS df FROM h GROUP BY w)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / a))), 6) AS score FROM h JOIN f USING (w), n GROUP BY doc_id""")
def fulltext_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), ["license", "released", "idiot"]).select("doc_id", F.round("score", 6).alias("score"))


@_query("""
WITH h AS (SELECT event_id AS hit_id, user_id, (epoch_us(ts) // 1000) AS t FROM events WHERE event_type = 'error')
SELECT hit_id, event_id FROM h JOIN events e ON e.user_id = h.user_id AND abs((epoch_us(e.ts) // 1000) - h.t) <= 7200000""")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", _millis(F.col("ts")).alias("t"))
    hits = e.filter("event_type = 'error'").withColumnRenamed("event_id", "hit_id")
    return retrieval.neighbours(hits, e, "user_id", "t", 2 * HOUR).select("hit_id", "event_id")


@_query("SELECT user_id, min((epoch_us(ts) // 1000)) AS first_seen, max((epoch_us(ts) // 1000)) AS last_seen, count(*) AS sightings FROM events WHERE value >= 50 GROUP BY user_id")
def first_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.first_last_seen(table(spark, sf_dir, "events").select("user_id", _millis(F.col("ts")).alias("t"), F.col("value").alias("score")), "user_id", "t", 50.0)


@_query("""
WITH a AS (SELECT event_id AS frame_id, row_number() OVER (ORDER BY value DESC, event_id) AS r FROM events WHERE event_type = 'error' QUALIFY r <= 100), b AS (SELECT event_id AS frame_id, row_number() OVER (ORDER BY event_id DESC) AS r FROM events WHERE value > 100 QUALIFY r <= 100),
u AS (SELECT frame_id, 1 / (60 + r) AS p, 'score' AS c FROM a UNION ALL SELECT frame_id, 1 / (60 + r), 'time' FROM b)
SELECT frame_id, round(sum(p), 9) AS score, string_agg(c, ',' ORDER BY c) AS channels FROM u GROUP BY frame_id""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")

    def top(df: DataFrame, *order: Column) -> DataFrame:
        """The top 100 of a channel, ranked: a report of fixed size."""
        return df.orderBy(*order).limit(100).withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(F.col("event_id").alias("frame_id"), "rank")

    x = retrieval.fuse({"score": top(e.filter("event_type = 'error'"), F.desc("value"), F.asc("event_id")), "time": top(e.filter("value > 100"), F.desc("event_id"))})
    return x.select("frame_id", F.round("score", 9).alias("score"), F.array_join("channels", ",").alias("channels"))


@_query("SELECT user_id, event_id FROM (SELECT *, lead(event_type, 1) OVER w AS b, lead(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'view' AND b = 'click' AND c = 'purchase'")
def sequence_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return retrieval.sequence_pattern(e, "user_id", "event_type", ["ts", "event_id"], ["view", "click", "purchase"]).select("user_id", "event_id")


@_query("SELECT event_id, props IS NOT NULL AS ok, CASE WHEN props IS NULL THEN 'null' END AS reason, replace(props, ' ', '') AS document FROM events")
def strict_json_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strict_json.verdicts(table(spark, sf_dir, "events").select("event_id", "props"), "props").select("event_id", "ok", "reason", "document")


@_query("""
WITH k AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 7),
x AS (SELECT l_orderkey AS batch_id, (l_linenumber::BIGINT * 100000 + l_partkey) * 10000 + l_suppkey AS pos, printf('%08x', l_partkey) || '-0000-4000-8000-000000000000' AS id, CASE WHEN k.l_partkey IS NOT NULL AND l_partkey % 2 = 0 THEN 'committed' ELSE 'pending' END AS state, l_orderkey % 4 = 0 AS bad FROM lineitem LEFT JOIN k USING (l_partkey))
SELECT batch_id, CASE WHEN NOT bad THEN string_agg(id || ':' || state, ',' ORDER BY pos) END AS frames, CASE WHEN bad THEN 'conflict' END AS error FROM x GROUP BY batch_id, bad""")
def batch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers come back in input order: the states of each batch's frames, or its error."""
    verdict = F.when(F.col("batch_id") % 4 == 0, "conflict").otherwise("accepted")
    x = _batches(spark, sf_dir).select("batch_id", "archive_id", "pos", F.col("metadata.frame_id").alias("frame_id"), verdict.alias("verdict"))
    x = manifest.responses(x, _catalog(spark, sf_dir))
    return x.select("batch_id", F.array_join(F.transform("frames", lambda f: F.concat_ws(":", f["frame_id"], f["state"])), ",").alias("frames"), "error")


@_query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicates(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@_query("SELECT c_custkey AS o_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) <> 1")
def exactly_one_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    return quality.exactly_one(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), wanted, ["o_custkey"])


@_query("SELECT 'result' AS \"column\", o_orderpriority AS value, count(*) AS n FROM orders WHERE o_orderpriority <> '1-URGENT' GROUP BY o_orderpriority")
def closed_set_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as results of attempts: urgent ones were saved, the others are no result at all."""
    result = F.when(F.col("o_orderpriority") == "1-URGENT", "SAVED").otherwise(F.col("o_orderpriority"))
    return quality.enum_violations(table(spark, sf_dir, "orders").select(result.alias("result")), "capture_attempts")


@_query("""
SELECT event_id, floor(least(value, 120.0)) BETWEEN 0 AND 100 AS ok, CASE WHEN floor(least(value, 120.0)) BETWEEN 0 AND 100 THEN floor(least(value, 120.0)) * 100.0 / 100 END AS percent FROM events""")
def battery_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = scalars.battery(F.floor(F.least(F.col("value"), F.lit(120.0))).cast("int"), F.lit(100))
    e = table(spark, sf_dir, "events").select("event_id", b.alias("b"))
    return e.select("event_id", scalars.battery_consistent(F.col("b.level"), F.col("b.scale"), F.col("b.percent")).alias("ok"), F.col("b.percent").alias("percent"))


@_query("""
SELECT event_id, (epoch_us(ts) // 3600000000) || ':' || lpad(((epoch_us(ts) // 60000000) % 60)::VARCHAR, 2, '0') || ':' || lpad(((epoch_us(ts) // 1000000) % 60)::VARCHAR, 2, '0') AS clock,
  strftime(ts, '%Y%m%d-%H%M%S') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim('.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0'), '0'), '.') || 'Z' AS rfc3339 FROM events""")
def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _millis(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", scalars.duration_text(at).alias("clock"), scalars.path_stamp(at).alias("stamp"), scalars.rfc3339_micros(_parts(F.col("ts"), 1_000_000)).alias("rfc3339"))


@_query("""
WITH n AS (SELECT o_custkey, count(*) AS tries, bool_or(o_orderstatus = 'F' AND o_orderkey % 5 = 0) AS done, max_by(o_orderstatus = 'O' AND o_orderkey % 2 = 0, o_orderkey) AS live, count(*) FILTER (WHERE NOT (o_orderstatus = 'O' AND o_orderkey % 2 = 0)) AS over FROM orders GROUP BY o_custkey)
SELECT c_custkey AS job_id, CASE WHEN done THEN 'done' WHEN live THEN 'running' WHEN over >= 3 THEN 'quarantined' ELSE 'ready' END AS state, coalesce(tries, 0) AS tries FROM customer LEFT JOIN n ON o_custkey = c_custkey""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = (F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 2 == 0)
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.lit(0).alias("started_ms"), F.when(~live, 1).alias("ended_ms"), ((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 5 == 0)).alias("ok"), F.col("o_orderkey").alias("attempt_seq"))
    return jobs.job_states(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("job_id")), a, 5, 10)


@_query("SELECT label, list_sort(list(vec_id)) AS frames FROM (SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY embedding[1]::DOUBLE DESC, vec_id) <= 3) GROUP BY label")
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("q"))
    return retrieval.keyframes(e, "label", "q", "vec_id", 3).groupBy("label").agg(F.array_sort(F.collect_list("vec_id")).alias("frames"))


@_query("""
WITH h AS (SELECT p_partkey AS id, (p_size::BIGINT * 40503 * 65536) + (p_partkey::BIGINT % 32) * 5 + (CASE WHEN p_partkey % 5 = 0 THEN 4611686018427387904 ELSE 0 END) AS h FROM part), u AS (SELECT h, min(id) AS id FROM h GROUP BY h)
SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM u a JOIN u b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 3""")
def similar_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of parts that differ between sizes in many bits, and within a size in few."""
    h = F.col("p_size").cast("long") * 40503 * 65536 + F.col("p_partkey") % 32 * 5 + F.when(F.col("p_partkey") % 5 == 0, F.lit(1 << 62)).otherwise(F.lit(0).cast("long"))
    return retrieval.similar_hashes(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("frame_id"), h.alias("phash")))


@_query("""
WITH q AS (SELECT user_id AS query_id, event_id AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank, event_type = 'error' AS good FROM events), b AS (SELECT query_id, min(rank) FILTER (WHERE good) AS best FROM q GROUP BY query_id HAVING bool_or(good))
SELECT round(avg((best <= 5)::INTEGER), 6) AS recall_5, round(avg((best <= 20)::INTEGER), 6) AS recall_20, round(avg((best <= 100)::INTEGER), 6) AS recall_100 FROM b""")
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("item_id"), "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")).alias("rank"))
    x = retrieval.recall_at(e, e.filter("event_type = 'error'").select("query_id", "item_id"), [5, 20, 100])
    return x.select(*[F.round(c, 6).alias(c) for c in x.columns])


@_query("""
WITH x AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS s FROM events), y AS (SELECT *, (t - s) // 86400000 AS b FROM x)
SELECT user_id, event_id FROM y WHERE b >= 1 QUALIFY row_number() OVER (PARTITION BY user_id, b ORDER BY t, event_id) = 1""")
def periodic_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", _millis(F.col("ts")).alias("t"))
    starts = e.groupBy("user_id").agg(F.min("t").alias("start_elapsed_ms"))
    return stateful.periodic(e, starts, 24 * HOUR, "user_id", "t", "event_id").select("user_id", "event_id")


@_query("SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY k) AS segments FROM (SELECT c_nationkey, c_mktsegment, min(c_custkey) AS k FROM customer GROUP BY ALL) GROUP BY c_nationkey")
def episode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_mktsegment")
    return retrieval.episode_text(c, "c_nationkey", ["c_custkey"], "c_mktsegment").select("c_nationkey", F.array_join("texts", ",").alias("segments"))


@_query("""
WITH o AS (SELECT o_custkey, count(*) AS n, bool_or(o_orderstatus = 'F') AS done FROM orders GROUP BY o_custkey)
SELECT CAST(ts AS DATE) AS day, count(*) AS frames, min(epoch_us(ts) // 1000) AS first_ms, max(epoch_us(ts) // 1000) AS last_ms, count(DISTINCT event_type) AS contents,
  sum(('0x' || substr(sha256(event_type), 1, 15))::BIGINT)::VARCHAR AS checksum, bool_and(coalesce(done, false)) AS synced
FROM events LEFT JOIN o ON o_custkey = event_id % 1500 GROUP BY 1""")
def daily_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames, each with the jobs of a customer's orders: a day is synced if each of its frames has a job that is done."""
    e = table(spark, sf_dir, "events")
    frames = e.select((F.col("event_id") % 1500).alias("id"), F.lit(1).alias("state"), F.lit(1).alias("bytes"), _millis(F.col("ts")).alias("saved_wall_ms"), F.sha2("event_type", 256).alias("sha256"))
    done = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("frame_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("ready").alias("state"))
    return sessions.daily_facts(frames, done).drop("bytes")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from strandline.plans import reading, rules, search  # noqa: F401  they register their queries

    return {name: q for name, (q, _) in _CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    queries()
    return {name: sql for name, (_, sql) in _CATALOGUE.items() if sql}
