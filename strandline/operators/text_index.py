"""Full-text search over a stored inverted index.

The index is a folder of segments. A segment holds, for each word and each cell of doc_ids (``cell`` of them, one after the other), a
block: how many documents of the cell have the word, the greatest count and the least length among them, and, in columns that only a
block's reader reads, the offset in the cell, the count and the length of each. Blocks are dealt to parts by the word's hash and lie
there by word and cell, so a search reads the parts, and in them the row groups, of its own words.

The greatest count and the least length bound what a word can add to the score of a document of the cell, whatever segments come
later: a count raises a score, a length lowers it. A cell whose bounds add up to less than the k-th best score found so far
cannot have a document among the first k, and its blocks are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.retrieval import query_words, tokenise

#: Parts that words are dealt to, doc_ids of a cell, and the room that bounds are given for rounding.
PARTS, CELL, ROOM = 64, 256, 1e-9
_BLOCK = "part int, word string, cell long, n int, most int, least int, offsets array<int>, tfs array<int>, lengths array<int>"


def _part(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(PARTS)).cast("int")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings in order of part, word, cell and offset to a row for each word and cell; the last one waits for the next batch."""
    held = None
    for batch in batches:
        if batch.num_rows:
            x = pa.table(batch.columns, names=batch.schema.names)
            x = (x if held is None else pa.concat_tables([held, x])).combine_chunks()
            word, cell = x["word"].combine_chunks(), x["cell"].to_numpy()
            new = np.asarray(pc.not_equal(word[1:], word[:-1])) | (cell[1:] != cell[:-1])
            starts = np.concatenate([[0], np.flatnonzero(new) + 1])
            held = x.slice(starts[-1])
            if len(starts) > 1:
                yield _block(x.slice(0, starts[-1]), starts[:-1])
    if held is not None:
        yield _block(held, np.zeros(1, int))


def _block(x: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    first, ends = x.select(["part", "word", "cell"]).take(pa.array(starts)).combine_chunks(), np.append(starts, x.num_rows)
    columns = {c: x[c].to_numpy() for c in ("offset", "tf", "length")}
    lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(columns[c])) for c in ("offset", "tf", "length")]
    facts = [pa.array(np.diff(ends).astype(np.int32)), pa.array(np.maximum.reduceat(columns["tf"], starts)), pa.array(np.minimum.reduceat(columns["length"], starts))]
    return pa.record_batch([*(first[c].combine_chunks() for c in ("part", "word", "cell")), *facts, *lists], names=["part", "word", "cell", "n", "most", "least", "offsets", "tfs", "lengths"])


def append_segment(docs: DataFrame, path: str, segment: int, doc_id: str = "doc_id", text: str = "text", cell: int = CELL) -> None:
    """Index ``docs`` as a new segment; writing a segment again replaces it. Segments are of one cell size and share no doc_id.

    Words are those of ``tokenise``. A document without words counts among the documents; a null doc_id does not.
    """
    raw = docs.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = raw.repartition("doc").select("doc", tokenise(F.col("text")).alias("words")).withColumn("length", F.size("words"))  # texts move, so that words need not
    totals = d.agg(F.count("*").alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).withColumns({"cell_size": F.lit(cell), "segment": F.lit(segment)})
    hits = d.select("doc", "length", F.explode("words").alias("word")).groupBy("doc", "length", "word").agg(F.count("*").cast("int").alias("tf"))
    at = F.floor(F.col("doc") / F.lit(cell))
    postings = hits.select(_part(F.col("word")).alias("part"), "word", at.alias("cell"), (F.col("doc") - at * cell).cast("int").alias("offset"), "tf", "length")
    dealt = postings.repartition("part", F.pmod("cell", F.lit(8))).sortWithinPartitions("part", "word", "cell", "offset")
    blocks = dealt.mapInArrow(_blocks, _BLOCK).withColumn("segment", F.lit(segment)).sortWithinPartitions("part", "word", "cell")  # in order already, which the writer must know
    for name, df, by in (("postings", blocks, ["segment", "part"]), ("totals", totals, ["segment"])):
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{path}/{name}")


class Plan(NamedTuple):
    """What a search reads: all blocks of its words, those read first, those that may still matter, and the k-th best score so far."""

    blocks: DataFrame
    first: DataFrame
    second: DataFrame
    threshold: float


class Search:
    """BM25 over an index; ``k1`` and ``b`` as there."""

    def __init__(self, spark: SparkSession, path: str, query: list[str], k1: float = 1.2, b: float = 0.75):
        totals = spark.read.parquet(f"{path}/totals")
        t = totals.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words"), F.max("cell_size").alias("cell")).first()
        self.spark, self.k1, self.b, self.cell = spark, k1, b, t.cell
        self.docs, self.average = t.docs or 0, (t.words or 0) / max(1, t.docs or 0)
        words = query_words(totals, query)
        parts = [r[0] for r in spark.createDataFrame([(w,) for w in words], "word string").select(_part(F.col("word"))).distinct().collect()]
        blocks = spark.read.parquet(f"{path}/postings").filter(F.col("part").isin(parts)).filter(F.col("word").isin(words))
        df = {r["word"]: r["df"] for r in blocks.groupBy("word").agg(F.sum("n").alias("df")).collect()}  # one row for each word asked for
        idf = F.create_map(*[F.lit(x) for w, n in df.items() for x in (w, n)]) if df else F.create_map(F.lit(""), F.lit(0).cast("long"))
        self.blocks = blocks.withColumn("idf", F.log(1 + (self.docs - idf[F.col("word")] + 0.5) / (idf[F.col("word")] + 0.5)))

    def weight(self, tf: Column, length: Column) -> Column:
        return F.col("idf") * (tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / F.lit(self.average))))

    def scores(self, blocks: DataFrame) -> DataFrame:
        """(doc_id, score) of all documents in some blocks: all that the query's words have in their cells."""
        posting = F.explode(F.arrays_zip("offsets", "tfs", "lengths")).alias("p")
        x = blocks.select("cell", "idf", posting)
        doc = F.col("cell") * self.cell + F.col("p.offsets")
        return x.groupBy(doc.alias("doc_id")).agg(F.sum(self.weight(F.col("p.tfs"), F.col("p.lengths"))).alias("score"))

    def plan(self, k: int) -> Plan:
        """The k cells with the greatest bounds are scored first: each has a document, so the k-th best score is known then."""
        cells = self.blocks.groupBy("segment", "cell").agg((F.sum(self.weight(F.col("most"), F.col("least"))) * (1 + ROOM)).alias("bound"))
        best = cells.orderBy(F.desc("bound"), "segment", "cell").limit(k).collect()
        here = self.spark.createDataFrame([(r["segment"], r["cell"]) for r in best], "segment int, cell long")
        numbers = sorted({r["cell"] for r in best})
        first = self.blocks.filter(F.col("cell").isin(numbers)).join(F.broadcast(here), ["segment", "cell"], "left_semi")  # k cells
        top = [r["score"] for r in self.scores(first).orderBy(F.desc("score")).limit(k).collect()]
        threshold = top[-1] if len(top) == k else float("-inf")
        rest = cells.filter(F.col("bound") >= threshold).join(F.broadcast(here), ["segment", "cell"], "left_anti").select("segment", "cell")
        return Plan(self.blocks, first, self.blocks.join(rest, ["segment", "cell"], "left_semi"), threshold)

    def top(self, k: int) -> DataFrame:
        """(doc_id, score) of the k best documents; of equal scores (to nine places) the smaller doc_id."""
        p = self.plan(k)
        return self.scores(p.first.unionByName(p.second)).orderBy(F.desc(F.round("score", 9)), "doc_id").limit(k)
