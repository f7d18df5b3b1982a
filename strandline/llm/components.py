"""Connected components by contraction: every node takes its least neighbour, and equal ends of links fall together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import shared


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for all ids in links (a, b); comp is the least id that can be reached. Nothing reaches the driver but counts.

    Each round at least halves the number of nodes that still have links, so rounds grow with its logarithm.
    Minima are pre-aggregated, so a hub costs no task more than its share.
    """
    spark = links.sparkSession
    edges = shared.keep(links.filter("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = shared.keep(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
        # a chain of least neighbours is followed at once, as far as two steps go
        to = shared.keep(least.join(least.select(F.col("a").alias("m"), F.col("m").alias("mm")), "m").select("a", F.col("mm").alias("m")), "least")
        shared.drop(spark, least)
        moved = edges.join(to, "a").select(F.col("m").alias("x"), "b").join(to.withColumnRenamed("a", "b"), "b").select(F.col("x").alias("a"), F.col("m").alias("b"))
        after = shared.keep(moved.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if labels is None:
            labels = to.select(F.col("a").alias("id"), F.col("m").alias("comp"))
        else:
            new = labels.join(to.select(F.col("a").alias("comp"), "m"), "comp", "left").select("id", F.coalesce("m", "comp").alias("comp"))
            old, labels = labels, shared.keep(new, "labels")
            shared.drop(spark, old, to)
        shared.drop(spark, edges)
        edges = after
    shared.drop(spark, edges)
    return labels if labels is not None else spark.createDataFrame([], "id long, comp long")
