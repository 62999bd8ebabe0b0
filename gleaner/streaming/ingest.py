"""Incremental ingestion: images that appear under the events root become jobs, observations and dead letters.

The checkpoint remembers which files were seen; each batch is written under its batch id with overwrite, so a batch that runs
again after a failure replaces what it left.  Observation ids are the batch's place in the upper bits and the row's in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..functions import paths as P


def image_stream(spark: SparkSession, root: str, c: Config = DEFAULT, files_per_batch: int = 1000) -> DataFrame:
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(f"{root.rstrip('/')}/{c.events_root}")
    path = F.regexp_replace(F.try_url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), "^[a-z]+:/*(?=/)", "")
    rows = rows.withColumn("path", path).where(P.in_folder(F.col("path"), "Gallery", c) & P.is_image(F.col("path")))
    return rows.select(P.event_of(F.col("path"), c).alias("event_name"), P.canonical(F.col("path"), root, c).alias("image_id"), "content")


def ingest(images: DataFrame, work: Callable[[DataFrame], tuple[DataFrame, DataFrame]], output: str, checkpoint: str) -> StreamingQuery:
    """work(batch) gives observations and failures; both are written once per batch.  Ends when all files are seen."""

    def batch(df: DataFrame, batch_id: int) -> None:
        observations, failed = work(df)
        numbered = observations.withColumn("observation_id", F.col("observation_id") + F.lit(batch_id << 40))
        numbered.write.mode("overwrite").parquet(f"{output}/observations/batch_id={batch_id}")
        failed.write.mode("overwrite").parquet(f"{output}/failed/batch_id={batch_id}")

    return images.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stream of job state changes: event_name, job_id, status, at."""
    return spark.readStream.schema(schema).parquet(path)


def latest_states(changes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Jobs that reach each state per event and ten-minute window, once the watermark has passed it."""
    return changes.withWatermark("at", late).groupBy(F.window("at", "10 minutes"), "event_name", "status").agg(F.approx_count_distinct("job_id").alias("jobs")).select("event_name", "status", F.col("window.start").alias("since"), "jobs")
