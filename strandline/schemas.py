"""Schemas of the tables, the enumerations and fixed dimensions. ``ingest_seq`` is the order of insertion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSION = 4

_PROFILE = "struct<id:string,requested_width:int,requested_height:int,jpeg_quality:int,negotiated_width:int,negotiated_height:int>"
METADATA = f"struct<frame_id:string,request_wall_ms:bigint,sha256:string,byte_length:bigint,session_id:string,request_elapsed_ms:bigint,saved_wall_ms:bigint,capture_settings:string,profile:{_PROFILE}>"

DDL = {
    "capture_sessions": "id string, journal_version int, profile_id string, requested_width int, requested_height int, jpeg_quality int, requested_settings string, start_wall_ms long, start_elapsed_ms long, end_wall_ms long, end_elapsed_ms long, recovery_detected_wall_ms long, terminal_reason string, completion_status string, manufacturer string, model string, android_release string, sdk_int int, build_id string, app_version string, app_version_code long, negotiated_width int, negotiated_height int, ingest_seq long",
    "telemetry_samples": "sample_id long, session_id string, wall_ms long, elapsed_ms long, reason string, battery_level int, battery_scale int, battery_percent double, battery_status int, battery_plugged int, battery_temperature_tenths_c int, charge_counter_uah long, current_now_ua long, current_average_ua long, energy_counter_nwh long, thermal_status int, public_free_bytes long, private_free_bytes long",
    "capture_attempts": "attempt_id string, session_id string, frame_id string, request_wall_ms long, request_elapsed_ms long, scheduled_due_elapsed_ms long, requested_interval_ms long, prepare_complete_elapsed_ms long, camera_invoke_ready_elapsed_ms long, camera_terminal_elapsed_ms long, disk_drained_elapsed_ms long, commit_complete_elapsed_ms long, result string, failure_phase string, ingest_seq long",
    "device_frames": "id string, state int, request_wall_ms long, request_elapsed_ms long, interval_ms long, settings string, cover_shadow string, sha256 string, bytes long, saved_wall_ms long, recovered int, locator_kind string, uri string, relative_path string, profile_id string, session_id string, requested_width int, requested_height int, jpeg_quality int, negotiated_width int, negotiated_height int, actual_width int, actual_height int, validated int, availability string, ingest_seq long",
    "owners": "id string",
    "archives": "id string, owner_id string",
    "devices": "id string, owner_id string, archive_id string, token_hash string, name string, revoked boolean",
    "invitations": "token_hash string, archive_id string, expires_at timestamp, consumed boolean",
    "frames": f"archive_id string, id string, owner_id string, registering_device_id string, metadata {METADATA}, committed_at timestamp",
    "jobs": "archive_id string, frame_id string, owner_id string, state string",
    "media_entries": "uri string, name string, path string, owner string, pending boolean, bytes long, trashed boolean",
    "luma": "session_id string, t_ms long, samples array<int>",
    "motion": "session_id string, t_ms long, score double",
}
PRIMARY_KEYS = {"capture_sessions": ["id"], "telemetry_samples": ["sample_id"], "capture_attempts": ["attempt_id"], "device_frames": ["id"], "owners": ["id"], "archives": ["id"], "devices": ["id"], "invitations": ["token_hash"], "frames": ["archive_id", "id"], "jobs": ["archive_id", "frame_id"]}
FOREIGN_KEYS = [
    ("archives", ["owner_id"], "owners", ["id"]),
    ("devices", ["owner_id"], "owners", ["id"]),
    ("devices", ["archive_id"], "archives", ["id"]),
    ("invitations", ["archive_id"], "archives", ["id"]),
    ("frames", ["archive_id"], "archives", ["id"]),
    ("frames", ["registering_device_id"], "devices", ["id"]),
    ("jobs", ["archive_id", "frame_id"], "frames", ["archive_id", "id"]),
]
ENUMS = {
    ("capture_sessions", "completion_status"): ["OPEN", "COMPLETE", "FAILED", "INTERRUPTED"],
    ("capture_attempts", "result"): ["PENDING", "SAVED", "CAMERA_FAILURE", "STORAGE_FAILURE", "INTERRUPTED"],
    ("telemetry_samples", "reason"): ["START", "PERIODIC", "THERMAL_CHANGE", "END"],
    ("device_frames", "availability"): ["AVAILABLE", "MISSING", "TRASHED", "INACCESSIBLE", "CHANGED", "CLEANUP_UNPROVEN"],
    ("device_frames", "state"): [0, 1, 2],
}
PENDING, COMMITTED, QUARANTINED = 0, 1, 2

#: Code, HTTP status, retryable.
ERRORS = [
    ("invalid_request", 400, False),
    ("unauthorized", 401, False),
    ("not_found", 404, False),
    ("conflict", 409, False),
    ("not_committed", 409, True),
    ("integrity_error", 409, False),
    ("payload_too_large", 413, False),
    ("unsupported_media_type", 415, False),
    ("checksum_mismatch", 422, True),
    ("invalid_image", 422, False),
    ("unavailable", 503, True),
]
#: Id, width, height, quality, wide.
PROFILES = [
    ("v1-4000x3000-q95", 4000, 3000, 95, False),
    ("v1-4000x3000-q80", 4000, 3000, 80, False),
    ("v1-1920x1080-q90", 1920, 1080, 90, True),
    ("v1-1920x1080-q80", 1920, 1080, 80, True),
    ("v1-1440x1080-q90", 1440, 1080, 90, False),
    ("v1-1440x1080-q80", 1440, 1080, 80, False),
]
#: How a session ended, its terminal reason and completion status; anything else is a recorder failure.
ENDINGS = [
    ("paused", "USER_PAUSE", "COMPLETE"),
    ("camera_error", "CAMERA_FAILURE", "FAILED"),
    ("storage_error", "STORAGE_FAILURE", "FAILED"),
    ("timeout", "CAPTURE_TIMEOUT", "FAILED"),
    ("interrupted", "SERVICE_DESTROYED", "INTERRUPTED"),
]


def schema(table: str) -> StructType:
    return StructType.fromDDL(DDL[table])


def create_tables(spark: SparkSession, database: str | None = None) -> None:
    """All tables as empty Parquet tables, where they are not there yet."""
    where = f"`{database}`." if database else ""
    for name, ddl in DDL.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {where}`{name}` ({ddl}) USING parquet")


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table, column, type) of all tables that the session's catalog has; names only, so the size is that of the schema."""
    names = [t.name for t in spark.catalog.listTables(database) if not t.isTemporary]
    found = [(n, c.name, c.dataType) for n in names for c in spark.catalog.listColumns(f"`{database}`.`{n}`" if database else f"`{n}`")]
    return spark.createDataFrame(found, "table string, column string, type string")


def catalog_differences(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(table, column, status) where the catalog and the schemas of this module do not agree: missing, extra or type."""
    expected = [(t, f.name, f.dataType.simpleString()) for t in DDL for f in schema(t).fields]
    want = spark.createDataFrame(expected, "table string, column string, wanted string")
    ours = want.select("table").distinct()
    both = catalog_columns(spark, database).join(ours, "table", "left_semi").join(want, ["table", "column"], "full_outer")
    status = F.when(F.col("type").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("type") != F.col("wanted"), "type")
    return both.select("table", "column", status.alias("status")).filter("status IS NOT NULL")


def error_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ERRORS, "code string, http_status int, retryable boolean")


def profile_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROFILES, "profile_id string, width int, height int, quality int, wide boolean")


def check_version(found: int, expected: int = VERSION) -> None:
    if found != expected:
        raise ValueError(f"schema version {found}, expected {expected}")
