"""Tables kept between steps, and names that do not clash.

Lineage is cut with tables written below ``spark.checkpoint.dir``, a folder that the driver and all
executors share; a lost executor costs its running tasks only.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one is set only where the setting is absent and all runs on this machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "strandline-shared")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(spark: SparkSession, rows: int = 2000) -> None:
    """At most so many rows to an Arrow batch: texts are long, and a batch is held on both sides of the pipe."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by ``keep`` that no later step reads."""
    jvm = spark.sparkContext._jvm
    for table in tables:
        for file in table.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def packed(df: DataFrame, *apart: str) -> DataFrame:
    """All columns in one struct ``__row``, beside the columns ``apart`` as ``__<name>``.

    An operator adds its own columns beside ``__row``, so no column of the input can clash with them.
    """
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *[F.col(f"`{c}`").alias(f"__{c}") for c in apart])


def unpacked(df: DataFrame, columns: list[str], added: list[str], without: tuple[str, ...] = ()) -> DataFrame:
    """The input's columns, then those added; of equal names, the added one stays."""
    old = [c for c in columns if c not in added and c not in without]
    return df.select(*[F.col("__row").getField(c).alias(c) for c in old], *[F.col(f"`{c}`") for c in added])


def over_salts(rows: DataFrame, key: str, salt: str, partial, total) -> DataFrame:
    """(key, salt, total) for all pairs of ``rows``: ``partial`` is worked out by pair, ``total`` over the pairs of a key.

    A join with it on both columns deals a hot key's rows over as many tasks as it has salts. Rows are aggregated before
    they move, and what is gathered for a key is a list of its salts.
    """
    pairs = rows.groupBy(key, salt).agg(partial)
    return pairs.groupBy(key).agg(total, F.collect_list(salt).alias(salt)).withColumn(salt, F.explode(salt))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
