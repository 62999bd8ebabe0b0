"""The whole resolution plan over observations of any number of events at once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import paths as P
from ..operators import clustering, jobs, matching, selection, state
from ..sources.scratch import staged


@dataclass(frozen=True)
class Result:
    observations: DataFrame
    assignments: DataFrame
    matches: DataFrame
    manifest: DataFrame
    report: DataFrame


def work_off(store: state.Store, worker: str, work: Callable[[DataFrame], tuple[DataFrame, DataFrame]], now: Callable[[], float], c: Config = DEFAULT) -> None:
    """Runs the open image jobs of all events to their end, failed ones once more; each batch is one commit.

    work(jobs) gives observations, with their observation_id or with local_ord to be numbered by, and failures (event_name,
    image_id, error).  Jobs that a lost run left behind are taken up again when they are stale.
    """
    at = store.version()
    store.commit({"observations": store.read("observations", at), "jobs": jobs.recover_stale(store.read("jobs", at), now(), c)}, at)
    for again in (False, True):
        at = store.version()
        table, old = store.read("jobs", at), store.read("observations", at)
        table = jobs.retry_failed(table) if again else table
        mine = table.where("status = 'PENDING'").select("event_name", "job_id", F.lit(worker).alias("worker"))
        if mine.isEmpty():
            continue
        at = store.commit({"observations": old, "jobs": jobs.claim(table, mine, now())}, at)
        taken = store.read("jobs", at).join(mine.select("event_name", "job_id"), ["event_name", "job_id"], "left_semi")
        taken = staged(taken.where((F.col("status") == "PROCESSING") & (F.col("worker_id") == worker)), "taken")
        found, failed = work(taken)
        if "local_ord" in found.columns:
            found = jobs.renumber(found, jobs.next_ids(old)).drop("local_ord")
        errors = failed.groupBy("event_name", "image_id").agg(F.min("error").alias("error"))
        outcomes = taken.select("event_name", "job_id", "image_id", F.col("worker_id").alias("worker")).join(errors, ["event_name", "image_id"], "left")
        state.save_and_complete(store, staged(found, "found"), staged(outcomes.drop("image_id"), "outcomes"), now())


def run(store: state.Store, refs: DataFrame, images: DataFrame | None = None, urls: DataFrame | None = None, c: Config = DEFAULT) -> tuple[Result, DataFrame]:
    """resolve() for the events whose jobs are done, and (event_name, reason) of the others, which stop none but themselves."""
    at = store.version()
    behind = staged(jobs.unfinished(store.read("jobs", at)), "behind")
    obs = store.read("observations", at).join(behind.select("event_name"), "event_name", "left_anti")
    return resolve(obs, refs, urls, c, images), behind


def resolve(obs: DataFrame, refs: DataFrame, urls: DataFrame | None = None, c: Config = DEFAULT, images: DataFrame | None = None) -> Result:
    """Cluster, match, select and report.  Events never meet: every join and window is keyed by event_name.

    images (event_name, image_path) are all reference images; their names give the phone numbers, whether or not they can
    be read.  Without them, those of refs do.
    """
    assignments = staged(clustering.cluster(obs, c), "assignments")
    matches = staged(matching.match_clusters(obs, assignments, refs, c), "matches")
    members = selection.members(obs, assignments)
    manifest = selection.person_manifest(members, matching.accepted(matches), c)
    if urls is None:
        urls = manifest.select("event_name", F.col("person_folder").alias("name"), F.concat(F.lit("output/"), P.url(F.concat("event_name", F.lit("/"), "person_folder"))).alias("link")).distinct()
    contacts = matching.contacts((refs if images is None else images).select("event_name", "image_path"))
    return Result(state.assign(obs, assignments), assignments, matches, manifest, selection.report(manifest, contacts, urls))
