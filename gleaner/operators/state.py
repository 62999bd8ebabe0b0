"""Keyed tables without MERGE: what a write leaves, and several tables that change together."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import quality as Q
from . import jobs as J


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new replaces the rows of old with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_observations(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new.withColumn("observation_type", Q.observation_type()), ["event_name", "observation_id"])


def assign(obs: DataFrame, assignments: DataFrame) -> DataFrame:
    """Observations with their cluster; those that aren't in assignments keep theirs."""
    new = assignments.select("event_name", "observation_id", F.col("cluster_id").alias("_new"), F.lit(True).alias("_set"))
    rows = obs.join(new, ["event_name", "observation_id"], "left")
    return rows.withColumn("cluster_id", F.when(F.col("_set"), F.col("_new")).otherwise(F.col("cluster_id"))).select(*obs.columns)


def add_missing(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns a table of an older layout lacks, as nulls."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns})


def write_events(df: DataFrame, path: str) -> None:
    """Replaces the events in df, and no others, in a table partitioned by event."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_name").parquet(path)


class Store:
    """Tables that change together: every commit writes all of them to a folder of its own, and its marker last.

    Readers take the newest version with a marker, so a commit is seen whole or not at all, whatever fails on the way.  Of
    several writers that go on from one version one succeeds, since a marker can be created once only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._place(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest committed version; 0 where there is none."""
        if not self._fs.exists(self._place(self.path)):
            return 0
        names = (s.getPath().getName() for s in self._fs.listStatus(self._place(self.path)) if s.getLen())
        return max((int(m[1]) for n in names if (m := re.fullmatch(r"committed-(\d+)", n))), default=0)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        marker = self._fs.open(self._place(f"{self.path}/committed-{version or self.version()}"))
        folder = marker.readLine()
        marker.close()
        return self.spark.read.parquet(f"{self.path}/{folder}/{table}")

    def commit(self, tables: dict[str, DataFrame], after: int) -> int:
        """Writes version after + 1; RuntimeError where `after` is no longer the newest."""
        folder = f"v{after + 1}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{name}")
        marker = self._place(f"{self.path}/committed-{after + 1}")
        if self.version() != after or self._fs.exists(marker):
            raise RuntimeError(f"version {after} is no longer the newest")
        out = self._fs.create(marker, False)
        out.writeBytes(folder)
        out.close()
        return after + 1


def save_and_complete(store: Store, observations: DataFrame, outcomes: DataFrame, now: float) -> int:
    """Saves the observations of a batch and ends its jobs in one commit, or does neither.

    outcomes: event_name, job_id, worker, error.  Raises where a job isn't processed by that worker any more.
    """
    at = store.version()
    jobs = store.read("jobs", at)
    lost = J.refused(jobs, outcomes).select("event_name", "job_id", "worker").limit(5).collect()
    if lost:
        raise RuntimeError(f"jobs that were recovered or claimed by others: {[tuple(r) for r in lost]}")
    saved = upsert_observations(store.read("observations", at), observations)
    return store.commit({"observations": saved, "jobs": J.finish(jobs, outcomes, now)}, at)
