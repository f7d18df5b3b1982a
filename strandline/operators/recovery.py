"""Reconciling catalogs with stored files, and rolling forward after a crash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.functions.jpeg import with_dimensions


def classify_names(listing: DataFrame, name: str = "name") -> DataFrame:
    """``listing`` and kind (lock, stage, original, unknown), archive_id and frame_id."""
    n = F.col(name)
    kind = F.when(n == ".lock", "lock").when(n.rlike(scalars.STAGE_NAME), "stage").when(n.rlike(scalars.OBJECT_NAME), "original").otherwise("unknown")
    return listing.withColumn("kind", kind).withColumn("archive_id", scalars.object_archive(n)).withColumn("frame_id", scalars.object_frame(n))


def audit(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: unknown (unreadable names, or originals without a catalog row) and stages."""
    known = catalog.select("archive_id", F.col("id").alias("frame_id"), F.lit(True).alias("known")).distinct()
    x = classify_names(listing).join(known, ["archive_id", "frame_id"], "left")
    unknown = (F.col("kind") == "unknown") | ((F.col("kind") == "original") & F.col("known").isNull())
    return x.agg(F.count_if(unknown).alias("unknown"), F.count_if(F.col("kind") == "stage").alias("stages"))


def unknown_originals(listing: DataFrame, catalog: DataFrame, keys: list[str]) -> DataFrame:
    return listing.join(catalog.select(*keys), keys, "left_anti")


def compare_sides(files: DataFrame, catalog: DataFrame, keys: list[str], size: str = "bytes", digest: str | None = None) -> DataFrame:
    """keys and status: unindexed (file only), missing (catalog only), changed (sizes, or with ``digest`` hashes, differ), or ok."""
    of = F.struct(size, *([digest] if digest else []))
    a = files.select(*keys, of.alias("__file"), F.lit(True).alias("__a"))
    b = catalog.select(*keys, of.alias("__known"), F.lit(True).alias("__b"))
    status = F.when(F.col("__b").isNull(), "unindexed").when(F.col("__a").isNull(), "missing").when(~F.col("__file").eqNullSafe(F.col("__known")), "changed").otherwise("ok")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def check_originals(files: DataFrame, catalog: DataFrame) -> DataFrame:
    """(archive_id, frame_id, code) of files (archive_id, frame_id, content) that the catalog knows; code is null if sound.

    The cheap checks come first and decide: length and hash, then the marks at both ends, then the header. Only rows
    that pass the first ones have their header read.
    """
    known = catalog.select("archive_id", F.col("id").alias("frame_id"), F.col("metadata.sha256").alias("sha256"), F.col("metadata.byte_length").alias("byte_length"))
    x = files.join(known, ["archive_id", "frame_id"])
    same = (F.length("content") == F.col("byte_length")) & (F.sha2("content", 256) == F.col("sha256"))
    x = x.withColumn("code", F.when(~F.coalesce(same, F.lit(False)), "checksum_mismatch").when(~scalars.jpeg_marked(F.col("content")), "invalid_image"))
    bad = x.filter("code IS NOT NULL").select("archive_id", "frame_id", "code")
    read = with_dimensions(x.filter("code IS NULL").select("archive_id", "frame_id", "content"))
    sized = read.select("archive_id", "frame_id", F.when(~F.coalesce(scalars.jpeg_size_ok(F.col("width"), F.col("height")), F.lit(False)), "invalid_image").alias("code"))
    return bad.unionByName(sized)


def recovery_actions(catalog: DataFrame, checked: DataFrame, known: Callable[[DataFrame], DataFrame] | None = None, publish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(archive_id, id, action) for pending frames: complete (sound bytes), wait (no bytes yet) or block (bytes that do not fit).

    ``known`` is asked before anything is decided: it gets the pending frames, and what it leaves out is left alone. ``publish``
    gets (archive_id, id) of the frames with sound bytes and gives those whose bytes it has put in place; the others wait.
    """
    found = checked.select("archive_id", F.col("frame_id").alias("id"), "code", F.lit(True).alias("__there"))
    pending = catalog.filter("committed_at IS NULL")
    x = (known(pending) if known else pending).join(found, ["archive_id", "id"], "left")
    x = x.select("archive_id", "id", F.when(F.col("__there").isNull(), "wait").when(F.col("code").isNull(), "complete").otherwise("block").alias("action"))
    if publish is None:
        return x
    placed = publish(x.filter("action = 'complete'").select("archive_id", "id")).select("archive_id", "id", F.lit(True).alias("__placed")).distinct()
    action = F.when((F.col("action") == "complete") & F.col("__placed").isNull(), "wait").otherwise(F.col("action"))
    return x.join(placed, ["archive_id", "id"], "left").select("archive_id", "id", action.alias("action"))


def namespace_ok(path: Column, prefix: str) -> Column:
    return F.startswith(path, F.lit(prefix)) & ~F.contains(path, F.lit(".."))


def _with_entries(frames: DataFrame, entries: DataFrame) -> DataFrame:
    """Frames with the entry of their uri, or without a uri of their name and path; entries is the number found."""
    e = F.struct("uri", "name", "path", "owner", "pending", "bytes", "trashed")
    by_uri = entries.groupBy("uri").agg(F.any_value(e).alias("__by_uri")).withColumnRenamed("uri", "__uri")
    by_name = entries.groupBy("name", "path").agg(F.any_value(e).alias("__by_name"), F.count("*").alias("__n")).withColumnsRenamed({"name": "__name", "path": "__path"})
    x = frames.join(by_uri, F.col("uri") == F.col("__uri"), "left").join(by_name, (F.concat("id", F.lit(".jpg")) == F.col("__name")) & (F.col("relative_path") == F.col("__path")), "left")
    return x.withColumn("entry", F.when(F.col("uri").isNotNull(), F.col("__by_uri")).otherwise(F.col("__by_name"))).withColumn("entries", F.when(F.col("uri").isNull(), F.coalesce("__n", F.lit(0))).otherwise(F.col("entry").isNotNull().cast("long"))).drop("__uri", "__by_uri", "__name", "__path", "__by_name", "__n")


def _owned(owner: str) -> Column:
    return (F.col("entry.owner") == owner) & (F.col("entry.name") == F.concat("id", F.lit(".jpg"))) & (F.col("entry.path") == F.col("relative_path"))


def availability(frames: DataFrame, entries: DataFrame, owner: str) -> DataFrame:
    """Committed media frames with available: the first rule that applies of missing, trashed, inaccessible, changed, available."""
    x = _with_entries(frames.filter("state = 1 AND locator_kind = 'media'"), entries)
    e = F.when(F.col("uri").isNotNull(), F.col("entry"))
    same = F.coalesce(_owned(owner) & F.col("entry.bytes").eqNullSafe(F.col("bytes")), F.lit(False))
    rule = F.when(e.isNull(), "MISSING").when(F.col("entry.trashed"), "TRASHED").when(F.col("entry.pending"), "INACCESSIBLE").when(~same, "CHANGED").otherwise("AVAILABLE")
    return x.withColumn("available", rule).drop("entry", "entries")


def pending_actions(frames: DataFrame, entries: DataFrame, contents: DataFrame, owner: str, prefix: str) -> DataFrame:
    """(id, action) for pending media frames after a crash.

    contents: (uri, sha256, bytes, width, height) as read now. Actions: delete (not validated, its own pending entry can go),
    quarantine (not validated and the entry is gone, so nothing proves what became of it), commit_missing (validated, the
    entry is gone), publish (validated and still pending, bytes as recorded), commit (validated, published already), and
    blocked_* where a rule is broken and nothing may be changed.
    """
    x = _with_entries(frames.filter("state = 0 AND locator_kind = 'media'"), entries)
    now = contents.select(F.col("uri").alias("__uri"), F.struct("sha256", "bytes", "width", "height").alias("__now"))
    x = x.join(now, F.col("entry.uri") == F.col("__uri"), "left")
    recorded = F.struct("sha256", "bytes", F.col("actual_width").alias("width"), F.col("actual_height").alias("height"))
    none, owned, pending = F.col("entry").isNull(), F.coalesce(_owned(owner), F.lit(False)), F.coalesce(F.col("entry.pending"), F.lit(False))
    action = (
        F.when(~F.coalesce(namespace_ok(F.col("relative_path"), prefix), F.lit(False)), "blocked_namespace")
        .when(F.col("entries") > 1, "blocked_ambiguous")
        .when(F.col("validated") != 1, F.when(none, "quarantine").when(~owned, "blocked_ownership").when(~pending, "blocked_published").otherwise("delete"))
        .when(none, "commit_missing")
        .when(pending & ~owned, "blocked_ownership")
        .when(pending & ~F.coalesce(recorded.eqNullSafe(F.col("__now")), F.lit(False)), "blocked_changed")
        .when(pending, "publish")
        .otherwise("commit")
    )
    return x.select("id", action.alias("action"))
