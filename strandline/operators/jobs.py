"""Extension: at-least-once jobs with leases, retries and quarantine, as a fold over a table of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def job_states(jobs: DataFrame, attempts: DataFrame, now_ms: int, lease_ms: int, most: int = 3) -> DataFrame:
    """(job_id, state, tries) for jobs and attempts (job_id, started_ms, ended_ms, ok, attempt_seq).

    done: an attempt succeeded, however many ran; running: the last attempt is within its lease; quarantined: ``most`` attempts
    ended or ran out of their lease; ready: anything else.
    """
    live = F.col("ended_ms").isNull() & (F.col("started_ms") + lease_ms > now_ms)
    one = attempts.groupBy("job_id").agg(F.count("*").alias("tries"), F.bool_or(F.coalesce("ok", F.lit(False))).alias("done"), F.max_by(live, F.col("attempt_seq")).alias("live"), F.count_if(~live).alias("over"))
    x = jobs.select("job_id").join(one, "job_id", "left")
    state = F.when(F.col("done"), "done").when(F.col("live"), "running").when(F.col("over") >= most, "quarantined").otherwise("ready")
    return x.select("job_id", state.alias("state"), F.coalesce("tries", F.lit(0)).alias("tries"))


def claim(states: DataFrame, n: int, now_ms: int) -> DataFrame:
    """The attempts to append for the first ``n`` ready jobs."""
    ready = states.filter("state = 'ready'").orderBy("job_id").limit(n)
    return ready.select("job_id", F.lit(now_ms).alias("started_ms"), F.lit(None).cast("long").alias("ended_ms"), F.lit(None).cast("boolean").alias("ok"), (F.col("tries") + 1).alias("attempt_seq"))


def facts(states: DataFrame) -> DataFrame:
    """One row: queue depth, running and failed jobs."""
    return states.agg(F.count_if(F.col("state") == "ready").alias("queue_depth"), F.count_if(F.col("state") == "running").alias("running"), F.count_if(F.col("state") == "quarantined").alias("failed"))


def first_success(attempts: DataFrame) -> DataFrame:
    """Of the attempts of each job the first that succeeded: its output counts, later ones do not."""
    row = F.struct(*[F.col(f"`{c}`") for c in attempts.columns])
    return attempts.filter("ok").groupBy("job_id").agg(F.min_by(row, F.col("attempt_seq")).alias("__r")).select("__r.*")
