"""Owner scope: views that show the rows of the session's owner, and none without one.

A convenience, not a security boundary: whoever can run SQL can set the variable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def declare(spark: SparkSession, variable: str = "owner", kind: str = "STRING") -> None:
    spark.sql(f"DECLARE OR REPLACE VARIABLE {variable} {kind} DEFAULT NULL")


def set_owner(spark: SparkSession, value: str | int | None, variable: str = "owner") -> None:
    literal = "NULL" if value is None else str(value) if isinstance(value, int) else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    spark.sql(f"SET VAR {variable} = {literal}")


def scoped(df: DataFrame, column: str = "owner_id", variable: str = "owner") -> DataFrame:
    """Null without an owner, so no row; with one it folds to a literal and reaches the scan."""
    return df.filter(F.expr(f"`{column}` = session.{variable}"))


def authenticate(devices: DataFrame, token_hash: str) -> DataFrame:
    """The scope (owner_id, archive_id, device_id) of a credential that is not revoked."""
    return devices.filter((F.col("token_hash") == token_hash) & ~F.col("revoked")).select("owner_id", "archive_id", F.col("id").alias("device_id"))


def redeem(invitations: DataFrame, archives: DataFrame, requests: DataFrame, now) -> DataFrame:
    """Devices to append for requests (token_hash, device_token_hash, name, ingest_seq): each valid invitation once, to the
    request that came first; without an order of arrival, or of equal ones, to the least hash."""
    valid = invitations.filter(~F.col("consumed") & (F.col("expires_at") > F.lit(now))).join(archives.select(F.col("id").alias("archive_id"), "owner_id"), "archive_id")
    arrival = [c for c in ("ingest_seq",) if c in requests.columns]
    first = requests.groupBy("token_hash").agg(F.min(F.struct(*arrival, "device_token_hash", "name")).alias("r"))
    from strandline.functions.scalars import new_id

    return valid.join(first, "token_hash").select(new_id(F.concat("token_hash", "r.device_token_hash")).alias("id"), "owner_id", "archive_id", F.col("r.device_token_hash").alias("token_hash"), F.col("r.name").alias("name"), F.lit(False).alias("revoked"), F.col("token_hash").alias("invitation_hash"))


def recovery_owners(owners: DataFrame) -> DataFrame:
    return owners.select("id").orderBy("id")


def archive_owner(archives: DataFrame, archive_id: str) -> DataFrame:
    return archives.filter(F.col("id") == archive_id).select("owner_id")
