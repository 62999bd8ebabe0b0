"""The image queue as pure transitions of a job table; the time is always an argument."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, JOB_STATES, Config
from .numbering import numbered


T = TypeVar("T")


def _when(jobs: DataFrame, cond: Column, **new: Column) -> DataFrame:
    cond = F.coalesce(cond, F.lit(False))
    return jobs.withColumns({n: F.when(cond, v).otherwise(F.col(n)) for n, v in new.items()})


def enqueue(jobs: DataFrame, images: DataFrame, now: float) -> DataFrame:
    """New PENDING rows for the images that have no job yet; ids go on from the largest."""
    fresh = images.select("event_name", "image_id", "image_path").dropDuplicates(["event_name", "image_id"]).join(jobs, ["event_name", "image_id"], "left_anti")
    top = jobs.groupBy("event_name").agg(F.max("job_id").alias("top"))
    fresh = numbered(fresh, "event_name", ["image_id"], "nth").join(top, "event_name", "left")
    null = lambda t: F.lit(None).cast(t)
    return fresh.select(
        "event_name", (F.coalesce("top", F.lit(0)) + F.col("nth")).cast("long").alias("job_id"), "image_id", "image_path", F.lit("PENDING").alias("status"), null("string").alias("worker_id"),
        F.lit(0).cast("long").alias("attempts"), F.lit(float(now)).alias("created_at"), null("double").alias("started_at"), null("double").alias("completed_at"), null("string").alias("error_message"),
    )


def next_job(jobs: DataFrame) -> DataFrame:
    """The pending job of least id in each event."""
    return jobs.where("status = 'PENDING'").groupBy("event_name").agg(F.min("job_id").alias("job_id"))


def claim(jobs: DataFrame, claims: DataFrame, now: float) -> DataFrame:
    """claims: event_name, job_id, worker; pending jobs of those go to PROCESSING."""
    j = jobs.join(claims.withColumnRenamed("worker", "_worker"), ["event_name", "job_id"], "left")
    mine = F.col("_worker").isNotNull() & (F.col("status") == "PENDING")
    return _when(
        j.withColumn("_mine", mine), F.col("_mine"), status=F.lit("PROCESSING"), worker_id=F.col("_worker"), attempts=F.col("attempts") + 1, started_at=F.lit(float(now)),
        completed_at=F.lit(None).cast("double"), error_message=F.lit(None).cast("string"),
    ).select(*jobs.columns)


def finish(jobs: DataFrame, outcomes: DataFrame, now: float) -> DataFrame:
    """outcomes: event_name, job_id, worker, error (null: completed).  Only the worker that processes a job can end it."""
    j = jobs.join(outcomes.select("event_name", "job_id", F.col("worker").alias("_worker"), F.col("error").alias("_error"), F.lit(True).alias("_there")), ["event_name", "job_id"], "left")
    ours = F.col("_there") & (F.col("worker_id") == F.col("_worker")) & (F.col("status") == "PROCESSING")
    j = j.withColumn("_ours", F.coalesce(ours, F.lit(False)))
    status = F.when(F.col("_error").isNull(), "COMPLETED").otherwise("FAILED")
    return _when(j, F.col("_ours"), status=status, completed_at=F.lit(float(now)), error_message=F.col("_error")).select(*jobs.columns)


def refused(jobs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes that no processing job of that worker answers to; a batch with any must be rolled back."""
    open_ = jobs.where("status = 'PROCESSING'").select("event_name", "job_id", F.col("worker_id").alias("worker"))
    return outcomes.join(open_, ["event_name", "job_id", "worker"], "left_anti")


def recover_stale(jobs: DataFrame, now: float, c: Config = DEFAULT) -> DataFrame:
    """Jobs that have been processed for too long are pending again; attempts stay."""
    stale = (F.col("status") == "PROCESSING") & (F.col("started_at") < now - c.stale_seconds)
    return _when(jobs.withColumn("_stale", stale), F.col("_stale"), status=F.lit("PENDING"), worker_id=F.lit(None).cast("string"), started_at=F.lit(None).cast("double")).select(*jobs.columns)


def retry_failed(jobs: DataFrame) -> DataFrame:
    """Jobs that failed at their first attempt are pending again."""
    again = (F.col("status") == "FAILED") & (F.col("attempts") == 1)
    null = F.lit(None)
    return _when(jobs.withColumn("_again", again), F.col("_again"), status=F.lit("PENDING"), worker_id=null.cast("string"), started_at=null.cast("double"), completed_at=null.cast("double"), error_message=null.cast("string")).select(*jobs.columns)


def counts(jobs: DataFrame) -> DataFrame:
    """Jobs per event and state, states without jobs included."""
    states = F.explode(F.array(*[F.lit(s) for s in JOB_STATES])).alias("status")
    every = jobs.select("event_name").distinct().select("event_name", states)
    return every.join(jobs.groupBy("event_name", "status").count(), ["event_name", "status"], "left").select("event_name", "status", F.coalesce("count", F.lit(0)).alias("n"))


def failed(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'FAILED'").select("event_name", "job_id", "image_id", "attempts", "error_message").orderBy("job_id")


def check_complete(jobs: DataFrame) -> None:
    """Raises while a job is pending or processed; failed ones are tolerated."""
    left = jobs.where("status in ('PENDING', 'PROCESSING')").groupBy("status").count().collect()
    if left:
        raise RuntimeError("jobs not done: " + ", ".join(f"{r['count']} {r['status']}" for r in sorted(left)))


def unfinished(jobs: DataFrame) -> DataFrame:
    """Events that aren't ready for what follows, and why: jobs pending or processed, or none at all that succeeded."""
    rows = jobs.groupBy("event_name").agg(F.count_if(F.col("status").isin("PENDING", "PROCESSING")).alias("open"), F.count_if(F.col("status") == "COMPLETED").alias("done"))
    why = F.when(F.col("open") > 0, F.format_string("%d jobs not done", "open")).when(F.col("done") == 0, "no image could be processed")
    return rows.select("event_name", why.alias("reason")).where("reason is not null")


def progress(counted: DataFrame, phase: str = "images") -> DataFrame:
    """Percent of images done per event, and of the whole run; phases after the images stand at fixed marks."""
    # Where the phases stand.
    marks = {"clustering": 70.0, "reference_matching": 88.0, "output": 95.0, "complete": 100.0}
    done = F.sum(F.when(F.col("status").isin("COMPLETED", "FAILED"), F.col("n")).otherwise(0))
    rows = counted.groupBy("event_name").agg(done.alias("done"), F.sum("n").alias("total"))
    images = F.when(F.col("total") > 0, F.round(F.col("done") / F.col("total") * 100.0, 1)).otherwise(0.0)
    overall = F.lit(marks[phase]) if phase in marks else F.round(F.col("images_percent") * 0.70, 1)
    return rows.withColumn("images_percent", images).withColumn("overall_percent", overall).select("event_name", "images_percent", "overall_percent")


#: What a log says in each phase, the latest first.
PHASE_MARKS = {
    "complete": ("PROCESSING COMPLETE",),
    "output": ("GENERATING FINAL OUTPUT", "[OUTPUT]"),
    "reference_matching": ("EVENT REFERENCE MATCHING", "REFERENCE MATCH", "ACCEPTED REFERENCE MATCHES"),
    "clustering": ("CONSTRAINED IDENTITY CLUSTERING",),
}


def log_tail(text: Column, most: int = 40000) -> Column:
    return F.when(F.length(text) > most, F.substring(text, -most, most)).otherwise(text)


def phase_of(text: Column) -> Column:
    """Phase of a run by the last 12,000 characters of its log."""
    tail = F.upper(log_tail(text, 12000))
    out = F.when(F.lit(False), "")
    for phase, marks in PHASE_MARKS.items():
        for m in marks:
            out = out.when(F.contains(tail, F.lit(m)), phase)
    return out.otherwise("image_processing")


def next_ids(obs: DataFrame) -> DataFrame:
    """The id from which new observations of an event are numbered."""
    return obs.groupBy("event_name").agg((F.coalesce(F.max("observation_id"), F.lit(-1)) + 1).alias("next_id"))


def renumber(obs: DataFrame, first: DataFrame) -> DataFrame:
    """New observations numbered per event by image and place in it, from next_id on."""
    rows = numbered(obs, "event_name", ["image_id", "local_ord"], "_nth").join(first, "event_name", "left")
    return rows.withColumn("observation_id", (F.coalesce("next_id", F.lit(0)) + F.col("_nth") - 1).cast("long")).drop("_nth", "next_id")


def retry_delays(retries: int) -> Column:
    """Seconds to wait before each further attempt: 1, 2, 4, 8, then 10."""
    return F.transform(F.sequence(F.lit(1), F.lit(retries)), lambda n: F.least(F.pow(F.lit(2.0), n - 1), F.lit(10.0)))


def is_retriable(status: Column) -> Column:
    """By HTTP status; errors without one are retriable."""
    # The states worth another attempt.
    return status.isNull() | status.isin(429, 500, 502, 503, 504)


def with_retry(operation: Callable[[], T], retries: int = 5, status: Callable[[Exception], int | None] = lambda e: getattr(e, "status", None), wait: Callable[[float], None] = time.sleep) -> T:
    """operation(), again after a pause where it fails in a way worth another attempt; the last failure is raised."""
    for n in range(retries + 1):
        try:
            return operation()
        except Exception as e:
            # The states worth another attempt; errors without one are, too.
            if n == retries or status(e) not in (None, 429, 500, 502, 503, 504):
                raise
            wait(min(2.0**n, 10.0))
    raise AssertionError
