"""Several tables that change together: files first, then one entry in a log, which makes all of them visible at once.

    <root>/data/<table>/<epoch>-<unique>/   files of one commit, written by Spark, seen by no reader yet
    <root>/log/<version>.json               the commit: which folders of which tables it adds, and which keys it deletes

An entry appears whole, by a rename that fails if the version is taken; whoever loses looks at the log again and takes the next one.
An epoch that the log has is not written again, so a repeated micro-batch changes nothing. Readers resolve tables through the log:
what a job left behind that died between two tables is never seen.

Deletes and updates rewrite nothing. A commit's deletes are a folder of keys, and hide rows of earlier versions; an update
deletes keys and adds the new rows in the same commit. ``compact`` writes what is visible as one commit that replaces the rest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit changed what this one rests on."""


def _java(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(conf), conf


def _entries(spark: SparkSession, root: str) -> list[dict]:
    """The log, oldest first: one small entry for each commit since the last compaction of all tables."""
    jvm, path, fs, _ = _java(spark, f"{root}/log")
    if not fs.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().endswith(".json"))
    if not names:
        return []
    rows = spark.read.text([f"{root}/log/{n}" for n in names], wholetext=True).select("value").collect()
    return sorted((json.loads(r.value) for r in rows), key=lambda e: e["version"])


def _publish(spark: SparkSession, root: str, entry: dict) -> bool:
    """Whether the entry is in the log now; False if its version was taken."""
    jvm, log, fs, conf = _java(spark, f"{root}/log")
    fs.mkdirs(log)
    draft = jvm.org.apache.hadoop.fs.Path(f"{root}/log/.{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(json.dumps(entry).encode())
    out.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(option, 1)
    options[0] = option.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(draft, jvm.org.apache.hadoop.fs.Path(f"{root}/log/{entry['version']:020d}.json"), options)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def committed(spark: SparkSession, root: str) -> set[str]:
    """The epochs that the log has."""
    return {e["epoch"] for e in _entries(spark, root)}


def commit(spark: SparkSession, root: str, tables: dict[str, DataFrame], epoch: str | int, deletes: dict[str, DataFrame] | None = None, partition: dict[str, list[str]] | None = None) -> bool:
    """Add rows to ``tables`` and hide those whose keys are in ``deletes``, all at once; False if the epoch was committed before.

    ``deletes`` holds the key columns only; keys with a null hide nothing. ``partition`` names columns to partition a table's files by.
    """
    epoch = str(epoch)
    if epoch in committed(spark, root):
        return False
    added, hidden = {}, {}
    for found, kind, frames in ((added, "data", tables), (hidden, "keys", deletes or {})):
        for name, df in frames.items():
            path = f"{kind}/{name}/{epoch}-{uuid.uuid4().hex}"
            w = df.write
            (w.partitionBy(*partition[name]) if kind == "data" and name in (partition or {}) else w).parquet(f"{root}/{path}")
            found[name] = {"path": path, "schema": df.schema.json()}
    while True:
        log = _entries(spark, root)
        if epoch in {e["epoch"] for e in log}:
            return False
        if _publish(spark, root, {"version": 1 + max((e["version"] for e in log), default=0), "epoch": epoch, "data": added, "keys": hidden}):
            return True


def read(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The visible rows of a table, now or as of a version. A table that no commit has names is unknown: KeyError."""
    log = [e for e in _entries(spark, root) if version is None or e["version"] <= version]
    start = max((e["version"] for e in log if name in e.get("replaces", [])), default=0)
    log = [e for e in log if e["version"] >= start]
    parts = [(e["version"], e["data"][name]) for e in log if name in e["data"]]
    if not parts:
        raise KeyError(name)
    schema = StructType.fromJson(json.loads(parts[-1][1]["schema"]))
    out = None
    for v, x in parts:
        df = spark.read.schema(schema).parquet(f"{root}/{x['path']}").select(*schema.names).withColumn("__version", F.lit(v))
        out = df if out is None else out.unionByName(df)
    for v, x in [(e["version"], e["keys"][name]) for e in log if name in e["keys"]]:
        keys = StructType.fromJson(json.loads(x["schema"]))
        gone = spark.read.schema(keys).parquet(f"{root}/{x['path']}").select(*[F.col(k).alias(f"__{k}") for k in keys.names]).withColumn("__before", F.lit(v))
        near = [F.col(k) == F.col(f"__{k}") for k in keys.names]
        out = out.join(gone, [*near, F.col("__version") < F.col("__before")], "left_anti")
    return out.drop("__version")


def compact(spark: SparkSession, root: str, name: str) -> None:
    """One commit with the visible rows of a table, which readers start from; Conflict if a commit came in meanwhile."""
    at = max((e["version"] for e in _entries(spark, root)), default=0)
    df = read(spark, root, name, at)
    path = f"data/{name}/compact-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{path}")
    if not _publish(spark, root, {"version": at + 1, "epoch": f"compact-{name}-{at}", "data": {name: {"path": path, "schema": df.schema.json()}}, "keys": {}, "replaces": [name]}):
        raise Conflict(name)


def commit_stream(stream: DataFrame, root: str, checkpoint: str, tables: Callable[[DataFrame], dict[str, DataFrame]]):
    """Commits each micro-batch of a stream: ``tables`` makes of it the rows of several tables, which appear together or not at all."""

    def write(df: DataFrame, epoch: int) -> None:
        commit(df.sparkSession, root, tables(df), f"stream-{epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
