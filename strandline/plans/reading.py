"""Registered queries for readers and writers that stand alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import kept
from strandline.operators import scope
from strandline.plans.catalogue import _attempts, _millis, _query, _samples
from strandline.plans.rules import _entries
from strandline.sources import readers, sinks
from strandline.sources.readers import driver_table as table


@_query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one customer with a key, as a row again."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    return spark.createDataFrame([readers.lookup(c, c_custkey=42)], c.schema)


@_query("""
SELECT event_id AS ingest_seq, epoch_us(ts) // 1000 AS request_elapsed_ms, row_number() OVER (ORDER BY epoch_us(ts) // 1000, event_id) AS place FROM events WHERE user_id = 7""")
def ordered_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts of one session in order, with the place that the order gives."""
    rows = readers.session_attempts(_attempts(spark, sf_dir), 7).select("ingest_seq", "request_elapsed_ms")
    return rows.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)


@_query("""
SELECT 'result' AS name, CASE event_type WHEN 'error' THEN 'CAMERA_FAILURE' WHEN 'signup' THEN 'STORAGE_FAILURE' WHEN 'purchase' THEN 'INTERRUPTED' ELSE 'SAVED' END AS value FROM events WHERE event_id = 11""")
def attempt_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _attempts(spark, sf_dir).withColumn("attempt_id", F.col("ingest_seq").cast("string"))
    return spark.createDataFrame([("result", readers.attempt_value(a, "11", "result"))], "name string, value string")


@_query("""
SELECT 'content://m/' || o_orderkey AS uri, CASE WHEN o_orderkey % 10 = 6 THEN 'other' ELSE 'me' END AS owner, o_orderkey % 10 IN (5, 8, 9) AS pending
FROM orders WHERE o_orderkey % 10 NOT IN (3, 4) AND o_orderkey % 10 <> 7""")
def media_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with the usual size, pending ones too, but none in the bin."""
    e = _entries(table(spark, sf_dir, "orders").select("o_orderkey"))
    return readers.media(e, F.col("bytes") == 10, pending=True, columns=("uri", "owner", "pending"))


@_query("SELECT doc_id AS name, sha256(text) AS sha256, strlen(text)::INTEGER AS bytes, false AS marked FROM documents")
def content_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files, in one pass: hash, size, and no marks of an image."""
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("text").cast("binary").alias("content"))
    return readers.content_facts(files).select("name", "sha256", "bytes", "marked")


@_query("SELECT c_nationkey::VARCHAR AS owner_id, c_custkey::VARCHAR AS device_id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 3 <> 0 AND c_custkey <> 2")
def active_credentials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as devices whose credential is their segment: every third is revoked, and then the second one too."""
    text = F.col("c_custkey").cast("string")
    devices = table(spark, sf_dir, "customer").select(text.alias("id"), F.col("c_nationkey").cast("string").alias("owner_id"), text.alias("archive_id"), F.col("c_mktsegment").alias("token_hash"), (F.col("c_custkey") % 3 == 0).alias("revoked"))
    return scope.authenticate(sinks.revoke(devices, "2"), "BUILDING").select("owner_id", "device_id")


@_query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS year_month, o_totalprice * CASE WHEN strftime(o_orderdate, '%Y-%m') IN ('1995-03', '1996-07') THEN 2 ELSE 1 END AS price FROM orders""")
def replaced_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written by month; two months are worked out again, and no other is touched."""
    path = kept.new_path(spark, "months")
    o = table(spark, sf_dir, "orders").select("o_orderkey", _millis(F.col("o_orderdate")).alias("at"), F.col("o_totalprice").alias("price"))
    sinks.write_months(o, path, "at")
    stored = spark.read.parquet(path)
    again = stored.filter(F.col("year_month").isin("1995-03", "1996-07")).withColumn("price", F.col("price") * 2).drop("year_month")
    sinks.replace_months(kept.keep(again, "months"), path, "at")
    return spark.read.parquet(path).select("o_orderkey", F.col("year_month").cast("string").alias("year_month"), "price")


@_query("SELECT o_orderkey, o_orderstatus FROM orders")
def published_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one status are published, those of the others appended, and an append of keys that are there adds nothing."""
    path = kept.new_path(spark, "published")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    sinks.publish(o.filter("o_orderstatus = 'F'"), path)
    sinks.append(o.filter("o_orderstatus <> 'F'"), path)
    sinks.append_absent(o.withColumn("o_orderstatus", F.lit("?")), path, ["o_orderkey"])
    return spark.read.parquet(path)


@_query("""
SELECT user_id AS session_id, event_id AS sample_id, CASE WHEN value >= 0 AND floor(least(value, 120.0)) <= 100 THEN floor(least(value, 120.0))::INTEGER END AS battery_level, NULL::INTEGER AS thermal_status FROM events WHERE event_type <> 'error'
UNION ALL SELECT user_id, event_id, CASE WHEN value >= 0 AND floor(least(value, 120.0)) <= 100 THEN floor(least(value, 120.0))::INTEGER END, 2 FROM events WHERE event_type = 'error'""")
def evolved_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with old names brought to the schema of today: renamed, cast, and filled up with nulls."""
    old = _samples(spark, sf_dir).withColumnRenamed("battery_level", "level").drop("private_free_bytes")
    new = sinks.evolve(old, "telemetry_samples", renamed={"level": "battery_level"})
    return new.select("session_id", "sample_id", "battery_level", "thermal_status").withColumn("session_id", F.col("session_id").cast("long"))
