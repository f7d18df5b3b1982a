"""Registration of frames in batches: idempotent, in input order, and all or nothing for each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline import kept
from strandline.functions import scalars
from strandline.operators import quality, skew

#: Version of the contract, frames of a batch at most, and two members of each receipt.
CONTRACT, MOST_FRAMES = "0.1.0", 100
INTEGRITY, STATE = "sha256-byte-length-jpeg-header", "archive_committed"


def receipts(catalog: DataFrame) -> DataFrame:
    """``catalog`` with state and receipt; a frame has a receipt if and only if it is committed."""
    m = lambda name: F.col(f"metadata.{name}").alias(name)
    receipt = F.struct(
        F.lit(CONTRACT).alias("contract_version"), F.col("archive_id"), F.col("id").alias("frame_id"), m("sha256"), m("byte_length"),
        scalars.rfc3339(F.col("committed_at")).alias("committed_at"), F.lit(INTEGRITY).alias("integrity"), F.lit(STATE).alias("state"),
    )
    done = F.col("committed_at").isNotNull()
    return catalog.withColumn("state", F.when(done, "committed").otherwise("pending")).withColumn("receipt", F.when(done, receipt))


def explode_batches(batches: DataFrame) -> DataFrame:
    """(batch_id, archive_id, frames: array of metadata) to one row a frame, with its place in the batch."""
    return batches.select("batch_id", "archive_id", F.size("frames").alias("batch_size"), F.posexplode("frames").alias("pos", "metadata"))


def _facts(frames: DataFrame, catalog: DataFrame) -> DataFrame:
    """A row for each frame id of each batch: its content as a hash (bytes: half of what its text would move), whether its rows are sound, and the catalog's content."""
    content = lambda m: F.unhex(F.sha2(F.to_json(m, {"ignoreNullFields": "false"}), 256))
    x = frames.select(
        "batch_id", "archive_id", F.col("metadata.frame_id").alias("frame_id"), content(F.col("metadata")).alias("content"),
        ((F.size(quality.metadata_violations()) == 0) & F.col("batch_size").between(1, MOST_FRAMES)).alias("valid"),
    )
    one = x.groupBy("batch_id", "archive_id", "frame_id").agg(F.min("content").alias("content"), (F.min("valid") & (F.count("*") == 1)).alias("valid"))
    known = catalog.select("archive_id", F.col("id").alias("frame_id"), content(F.col("metadata")).alias("stored"))
    return skew.join_facts(one, known, ["archive_id", "frame_id"], F.col("batch_id"))


def _earlier(rows: DataFrame) -> DataFrame:
    """For each frame the earliest batch with its content, and the earliest one with another content."""
    frame = ["archive_id", "frame_id"]
    by_content = rows.groupBy(*frame, "content").agg(F.min("batch_id").alias("batch_id"))
    first = by_content.groupBy(*frame).agg(F.min(F.struct("batch_id", "content")).alias("first"))
    other = by_content.join(first, frame).filter(F.col("content") != F.col("first.content")).groupBy(*frame).agg(F.min("batch_id").alias("other"))
    return first.join(other, frame, "left").select(*frame, F.col("first.batch_id").alias("first"), F.col("first.content").alias("first_content"), "other")


def _conflicts(asked: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """The batches of ``asked`` (batch_id, archive_id, frame_id, content) that are refused when they come in order of batch_id.

    A batch is refused if an earlier batch that was accepted has other contents under one of its ids, and it is accepted when no
    earlier batch with other contents under any of its ids is left to decide. Each round decides, for all batches at once,
    those of which that is known: the earliest one left at least, so rounds are as many as the longest chain of batches
    each of which hangs on the one before. Only ids with several contents are looked at, as hashes, and rows of one id are
    aggregated by content before they meet. ``rounds`` gets the number of rows left after each.
    """
    spark, frame = asked.sparkSession, ["archive_id", "frame_id"]
    contested = asked.groupBy(*frame).agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low <> high").select(*frame)
    left = kept.keep(skew.join_facts(asked, contested, frame, F.col("batch_id"), "inner"), "batches")
    refused = spark.createDataFrame([], left.select("batch_id").schema)
    batch = Window.partitionBy("batch_id")  # MOST_FRAMES rows at most
    while not left.isEmpty():
        near = skew.join_facts(left, _earlier(left), frame, F.col("batch_id"))
        waits_for = F.when(F.col("content") == F.col("first_content"), F.col("other")).otherwise(F.col("first"))
        rows = near.select("batch_id", *frame, "content", F.max(F.coalesce(waits_for < F.col("batch_id"), F.lit(False))).over(batch).alias("waits"))
        taken = rows.filter("NOT waits").groupBy(*frame).agg(F.min("content").alias("taken"))  # batches accepted in a round agree
        judged = skew.join_facts(rows, taken, frame, F.col("batch_id"))
        against = F.max(F.coalesce(F.col("content") != F.col("taken"), F.lit(False))).over(batch)
        judged = kept.keep(judged.select("batch_id", *frame, "content", F.when(~F.col("waits"), "accepted").when(against, "refused").otherwise("waits").alias("state")), "batches")
        refused = refused.unionByName(judged.filter("state = 'refused'").select("batch_id").distinct())
        left = judged.filter("state = 'waits'").drop("state")
        if rounds is not None:
            rounds.append(left.count())
    return refused


def batch_decisions(frames: DataFrame, catalog: DataFrame, rounds: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(batch_id, verdict) of each batch, and the contents by frame of each batch that verdicts rest on."""
    facts = kept.keep(_facts(frames, catalog), "facts")
    same = F.coalesce(F.col("stored") == F.col("content"), F.lit(True))
    alone = facts.groupBy("batch_id").agg(F.min("valid").alias("valid"), F.min(same).alias("same"))
    asked = facts.filter("stored IS NULL").join(alone.filter("valid AND same").select("batch_id"), "batch_id", "left_semi")
    refused = _conflicts(asked.select("batch_id", "archive_id", "frame_id", "content"), rounds).withColumn("refused", F.lit(True))
    verdict = F.when(~F.col("valid"), "invalid_request").when(~F.col("same") | F.col("refused").isNotNull(), "conflict").otherwise("accepted")
    return alone.join(refused, "batch_id", "left").select("batch_id", verdict.alias("verdict")), facts


def batch_verdicts(frames: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each frame of each batch: frame_ok, is_new, and the batch's verdict: accepted, invalid_request or conflict.

    frames: batch_id, archive_id, batch_size, pos, metadata. Batches come in order of batch_id, each one whole or not at all. A frame
    conflicts if the catalog, or an earlier batch that was accepted, has other metadata under its id; the same metadata again is
    a retry and changes nothing. Frames of refused batches bind no one. frame_ok tells whether the frame by itself is sound
    and fits; is_new marks the one row with which an accepted batch registers it.
    """
    verdicts, facts = batch_decisions(frames, catalog)
    key = ["archive_id", "frame_id"]
    good = facts.join(verdicts.filter("verdict = 'accepted'").select("batch_id"), "batch_id", "left_semi")
    first = good.groupBy(*key).agg(F.min(F.struct("batch_id", "content")).alias("first"))
    x = skew.join_facts(facts.join(verdicts, "batch_id"), first, key, F.col("batch_id"))
    mine = F.col("first.batch_id") == F.col("batch_id")
    fits = F.coalesce(F.col("stored"), F.when(F.col("first.batch_id") < F.col("batch_id"), F.col("first.content")), F.col("content")) == F.col("content")
    x = x.select("batch_id", *key, "verdict", (F.col("valid") & fits).alias("frame_ok"), (F.col("stored").isNull() & F.coalesce(mine, F.lit(False))).alias("is_new"))
    rows = frames.select("batch_id", "archive_id", "pos", F.col("metadata.frame_id").alias("frame_id"), "metadata")
    near = [rows[c].eqNullSafe(x[c]) for c in ("batch_id", "archive_id", "frame_id")]
    return rows.join(x, near).select(rows["batch_id"], rows["archive_id"], "pos", rows["frame_id"], "metadata", "frame_ok", "is_new", "verdict")


def accepted_frames(verdicts: DataFrame) -> DataFrame:
    """Frames to append: those of accepted batches that no catalog row and no earlier accepted batch has."""
    return verdicts.filter("verdict = 'accepted' AND is_new").select("archive_id", F.col("frame_id").alias("id"), "metadata")


def responses(verdicts: DataFrame, catalog: DataFrame) -> DataFrame:
    """For each accepted batch the states of its frames, in input order; for others the error code."""
    states = receipts(catalog).select("archive_id", F.col("id").alias("frame_id"), "state", "receipt")
    x = verdicts.join(states, ["archive_id", "frame_id"], "left").withColumn("state", F.coalesce("state", F.lit("pending")))
    frames = F.array_sort(F.collect_list(F.struct("pos", "frame_id", "state", "receipt")))
    answers = F.transform(frames, lambda f: F.struct(f["frame_id"].alias("frame_id"), f["state"].alias("state"), f["receipt"].alias("receipt")))
    return x.groupBy("batch_id", "verdict").agg(answers.alias("frames")).select("batch_id", F.when(F.col("verdict") == "accepted", F.col("frames")).alias("frames"), F.when(F.col("verdict") != "accepted", F.col("verdict")).alias("error"))


def insert_if_absent(new: DataFrame, old: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of ``new`` to append: keys that ``old`` does not have, once each (the first in ``order``)."""
    w = Window.partitionBy(*keys).orderBy(*(order or keys))
    return new.join(old.select(*keys), keys, "left_anti").withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def complete(catalog: DataFrame, verified: DataFrame, at) -> tuple[DataFrame, DataFrame]:
    """(catalog, jobs to append): frames (archive_id, id) verified get the time ``at`` if they have none; one job for each."""
    now = catalog.join(verified.select("archive_id", "id", F.lit(True).alias("__ok")).distinct(), ["archive_id", "id"], "left")
    due = F.col("__ok") & F.col("committed_at").isNull()
    jobs = now.filter(due).select("archive_id", F.col("id").alias("frame_id"), "owner_id", F.lit("pending").alias("state"))
    return now.withColumn("committed_at", F.when(due, F.lit(at)).otherwise(F.col("committed_at"))).select(*catalog.columns), jobs
