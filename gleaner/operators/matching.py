"""Clusters against known references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import paths as P
from ..functions import vector as V
from .scoring import dealt


def references(faces: DataFrame) -> DataFrame:
    """One row per reference image: name, phone, unit vector, place.

    faces: event_name, image_path, face_ord, confidence, embedding, and maybe bbox.  Of an image's faces with an embedding
    that of largest confidence counts, of equals the largest, then the first.
    """
    b = F.col("bbox") if "bbox" in faces.columns else None
    area = F.lit(0) if b is None else F.coalesce(F.greatest(b["x2"] - b["x1"], F.lit(0)) * F.greatest(b["y2"] - b["y1"], F.lit(0)), F.lit(0))
    first = Window.partitionBy("event_name", "image_path").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), area.desc(), "face_ord")
    best = faces.where("embedding is not null").withColumn("nth", F.row_number().over(first)).where("nth = 1")
    in_order = Window.partitionBy("event_name").orderBy("image_path")
    out = best.select(
        "event_name", "image_path", P.person_name(F.col("image_path")).alias("person_name"), P.phone_number(F.col("image_path")).alias("phone_number"),
        V.normalise_finite_norm(F.col("embedding")).alias("embedding"),
    )
    return out.where("embedding is not null and person_name <> ''").withColumn("reference_ord", F.row_number().over(in_order))


def contacts(images: DataFrame) -> DataFrame:
    """First phone number of each person in path order, of all reference images, readable or not."""
    named = images.select("event_name", "image_path", P.person_name(F.col("image_path")).alias("person_name"), P.phone_number(F.col("image_path")).alias("phone_number"))
    return named.where("phone_number <> ''").groupBy("event_name", "person_name").agg(F.min(F.struct("image_path", "phone_number"))["phone_number"].alias("phone_number"))


def similarities(obs: DataFrame, assignments: DataFrame, refs: DataFrame) -> DataFrame:
    """Each assigned valid face with each reference of its event."""
    faces = obs.where("face_embedding_valid and face_embedding is not null").select("event_name", "observation_id", V.normalise_finite_norm(F.col("face_embedding")).alias("face"))
    faces = faces.join(assignments.where("cluster_id is not null").select("event_name", "observation_id", "cluster_id"), ["event_name", "observation_id"])
    # A large event's faces are dealt over tasks, its references go to all of them.
    faces = dealt(faces)
    blocks = faces.select("event_name", "block").distinct()
    known = refs.select("event_name", "person_name", "image_path", "reference_ord", "embedding").join(blocks, "event_name")
    both = faces.drop("blocks").join(known, ["event_name", "block"]).drop("block")
    return both.withColumn("score", V.dot(F.col("face"), F.col("embedding"))).where("score > -1").drop("face", "embedding")


def best_references(sims: DataFrame) -> DataFrame:
    """The best reference of each person for each cluster; of equals the first by reference, then observation."""
    best = F.max_by(F.struct("image_path", "score"), F.struct("score", -F.col("reference_ord"), -F.col("observation_id")))
    return sims.groupBy("event_name", "cluster_id", "person_name").agg(best.alias("b")).select("event_name", "cluster_id", "person_name", F.col("b.image_path").alias("reference_image"), F.col("b.score").alias("score"))


def match(best: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """One row per cluster: its best person, the margin over the second, and whether it is accepted.

    Without a second person the margin is taken to a score of -1.
    """
    rank = Window.partitionBy("event_name", "cluster_id").orderBy(F.desc("score"), F.lower("person_name"))
    all_ = Window.partitionBy("event_name", "cluster_id")
    ranked = best.withColumn("nth", F.row_number().over(rank)).withColumn("margin", F.col("score") - F.lead("score", 1, -1.0).over(rank)).withColumn("candidate_count", F.count(F.lit(1)).over(all_))
    accepted = (F.col("score") >= c.match) & ((F.col("candidate_count") == 1) | (F.col("margin") >= c.margin))
    return ranked.where("nth = 1").select("event_name", "cluster_id", "person_name", "score", "margin", "reference_image", accepted.alias("accepted"), "candidate_count")


def match_clusters(obs: DataFrame, assignments: DataFrame, refs: DataFrame, c: Config = DEFAULT) -> DataFrame:
    return match(best_references(similarities(obs, assignments, refs)), c)


def accepted(matches: DataFrame) -> DataFrame:
    """What is stored of a match."""
    kept = matches.where("accepted and person_name is not null and person_name <> ''")
    return kept.select("event_name", "cluster_id", "person_name", F.round("score", 6).alias("similarity"), F.round("margin", 6).alias("margin"), "reference_image")
