"""From raw documents to token ids: the stages of the corpus pipeline.

Each stage takes (spark, docs, sf_dir) and gives a table that is written before the next stage reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import shared
from strandline.llm.bpe import bpe_round_trip
from strandline.llm.minhash_dedup import near_dedup
from strandline.llm.mixing import mix, repeat_copies
from strandline.llm.quality import accepted
from strandline.llm.substring_dedup import substring_dedup

#: Weights of the domains: what the quality classifier let pass of the low one is not built up again.
TARGETS = {"low": 0.005, "clean": 0.965, "toxic": 0.03}
#: Least and most rate by likeliest domain: no clean document is lost, and no low one is drawn more than once.
BOUNDS = {"clean": (1, float("inf")), "low": (0, 1)}
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame) -> DataFrame:
    return df.select(*COLUMNS)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; all of them where there is nothing to learn it from."""
    return _documents(accepted(docs, _labels(spark, sf_dir)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity of 0.8 or more."""
    return _documents(near_dedup(docs, shingle=5, part=80, whole=100).filter("kept"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows of 35 words that start more than once. A text of which nothing is left stays, empty."""
    cut = substring_dedup(docs, window=35)
    return _documents(cut.withColumn("n_chars", F.length("text").cast("long")))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says; one whose likeliest domain is clean, once at least."""
    return _documents(repeat_copies(mix(docs, _labels(spark, sf_dir), TARGETS, bounds=BOUNDS)))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, checked by decoding."""
    import public_tokenizers

    out = bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_text=False)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", substrings),
    ("mixing to target weights", mixing),
    ("byte-level BPE", tokens),
]

#: The classifiers and the mixing cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents, each written and read again.

    Documents have the columns COLUMNS, in any order; others are left behind by the first stage. A null text is judged, and
    encoded, as an empty one; empty texts and rows without doc_id stay rows. Of documents with one doc_id the near-dedup makes one
    document. Without labels the first stage passes all, and the mixing draws each once. Empty tables give an empty one.
    """
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if k < len(STAGES) - 1:
            df = shared.keep(df, f"stage{k}")
    return df
