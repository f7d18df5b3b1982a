"""Reading tables, folders of originals and request documents."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import schemas
from strandline.functions import scalars, strict_json


class NotFound(LookupError):
    """No row has the key."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the catalog, with its fixed schema."""
    return spark.read.schema(schemas.schema(name)).parquet(f"{folder}/{name}.parquet")


def driver_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checked(spark: SparkSession, folder: str, expected: int = schemas.VERSION) -> str:
    """``folder``, if its version table has the expected schema version."""
    found = [r[0] for r in spark.read.parquet(f"{folder}/schema_version.parquet").select("version").limit(2).collect()]
    schemas.check_version(found[0] if len(found) == 1 else -1, expected)
    return folder


def lookup(df: DataFrame, **key: object) -> dict:
    """The one row with this key as a dict; NotFound without one, ValueError with several."""
    for name, value in key.items():
        df = df.filter(F.col(name) == F.lit(value))
    rows = df.limit(2).collect()
    if not rows:
        raise NotFound(str(key))
    if len(rows) > 1:
        raise ValueError(f"several rows for {key}")
    return rows[0].asDict(recursive=True)


def where(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows that meet all conditions, given as columns and never as text."""
    for c in conditions:
        df = df.filter(c)
    return df


def session_samples(samples: DataFrame, session_id: str) -> DataFrame:
    return samples.filter(F.col("session_id") == session_id).orderBy("elapsed_ms", "sample_id")


def session_attempts(attempts: DataFrame, session_id: str) -> DataFrame:
    return attempts.filter(F.col("session_id") == session_id).orderBy("request_elapsed_ms", "ingest_seq")


READABLE = ("prepare_complete_elapsed_ms", "camera_invoke_ready_elapsed_ms", "camera_terminal_elapsed_ms", "disk_drained_elapsed_ms", "commit_complete_elapsed_ms", "result", "failure_phase")


def attempt_value(attempts: DataFrame, attempt_id: str, column: str) -> object:
    """One of the columns that may be asked for; null is a value, a missing row is an error."""
    if column not in READABLE:
        raise ValueError(f"{column} cannot be read")
    return lookup(attempts.select("attempt_id", column), attempt_id=attempt_id)[column]


def keyset_page(df: DataFrame, columns: list[str], after: list | None = None, size: int = 100) -> DataFrame:
    """The next ``size`` rows in the order of ``columns`` after a key; the first page without one."""
    if after is not None:
        df = df.filter(scalars.row_after(columns, after))
    return df.orderBy(*columns).limit(size)


def originals(spark: SparkSession, folder: str, content: bool = False, most: int = scalars.MAX_BYTES) -> DataFrame:
    """(name, bytes, modified[, content]) of the files of a folder; the content of a file of more than ``most`` bytes is null.

    Without contents nothing but the listing is read. Spark passes over names that begin with a dot or underscore: see ``staged``.
    """
    files = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    if content:
        small = F.when(F.col("length") <= most, F.col("content"))
        return files.select(name.alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), small.alias("content"))
    return files.select(name.alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def staged(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes) of hidden files of a folder, through Hadoop's file system, so any store works."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(conf).listStatusIterator(path)
    rows = []
    while found.hasNext():
        s = found.next()
        if s.isFile() and s.getPath().getName().startswith((".", "_")) and not s.getPath().getName().endswith(".crc"):
            rows.append((s.getPath().getName(), s.getLen()))
    return spark.createDataFrame(rows, "name string, bytes long")


def legacy_originals(spark: SparkSession, folder: str, pattern: str = "*.jpg") -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"))


def content_facts(files: DataFrame) -> DataFrame:
    """Files (name, content) in one pass: sha256, bytes, marks at both ends, and size in pixels."""
    from strandline.functions.jpeg import with_dimensions

    return with_dimensions(files.select("name", F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"), scalars.jpeg_marked(F.col("content")).alias("marked"), "content"))


def requests(spark: SparkSession, folder: str, kind: strict_json.Kind = strict_json.MANIFEST) -> DataFrame:
    """(path, ok, reason, document) of whole files, read strictly."""
    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return strict_json.verdicts(files, "content", kind).drop("content")


def manifests(verdicts: DataFrame) -> DataFrame:
    """Accepted manifests with their frames as typed structs."""
    typed = F.from_json("document", f"struct<frames:array<{schemas.METADATA}>>")
    return verdicts.filter("ok").withColumn("frames", typed["frames"])


def media(entries: DataFrame, *conditions: Column, pending: bool = False, trashed: bool = False, columns: Iterable[str] = ("uri", "name", "path", "owner", "pending", "bytes", "trashed")) -> DataFrame:
    """Media entries; pending and trashed ones only on request."""
    if not pending:
        entries = entries.filter(~F.col("pending"))
    if not trashed:
        entries = entries.filter(~F.col("trashed"))
    return where(entries, *conditions).select(*columns)
