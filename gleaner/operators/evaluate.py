"""Evaluation against labelled truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import geometry as G
from ..functions import quality as Q


def cluster_purity(labelled: DataFrame) -> DataFrame:
    """labelled: event_name, cluster_id, true_person.  Size, largest share of one person, and whether persons are mixed."""
    per = labelled.where("cluster_id is not null").groupBy("event_name", "cluster_id", "true_person").count()
    out = per.groupBy("event_name", "cluster_id").agg(F.sum("count").alias("size"), F.max("count").alias("top"), F.count(F.lit(1)).alias("persons"))
    return out.select("event_name", "cluster_id", "size", (F.col("top") / F.col("size")).alias("purity"), (F.col("persons") > 1).alias("is_mixed"))


def false_merge_rate(purity: DataFrame) -> DataFrame:
    return purity.groupBy("event_name").agg(F.avg(F.col("is_mixed").cast("double")).alias("false_merge_rate"), F.avg("purity").alias("mean_purity"))


def fragmentation(labelled: DataFrame) -> DataFrame:
    """Clusters that each person is spread over."""
    return labelled.where("cluster_id is not null").groupBy("event_name", "true_person").agg(F.count_distinct("cluster_id").alias("clusters"))


def unassigned_rate(assignments: DataFrame) -> DataFrame:
    return assignments.groupBy("event_name").agg(F.avg(F.col("cluster_id").isNull().cast("double")).alias("unassigned_rate"))


def same_image_violations(rows: DataFrame) -> DataFrame:
    """Clusters that hold more than one observation of an image."""
    return rows.where("cluster_id is not null").groupBy("event_name", "cluster_id", "image_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def pose_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs and their mean score by poses; pairs: pose_a, pose_b, score."""
    a, b = Q.known_pose(F.col("pose_a")), Q.known_pose(F.col("pose_b"))
    return pairs.groupBy(F.least(a, b).alias("pose_1"), F.greatest(a, b).alias("pose_2")).agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))


def anchor_counts(obs: DataFrame, c: Config = DEFAULT) -> DataFrame:
    rows = obs.withColumn("_anchor", Q.is_anchor(c)).withColumn("_valid", Q.is_valid_face())
    return rows.groupBy("event_name").agg(F.count_if("_anchor").alias("anchors"), F.count_if("_valid").alias("valid_faces"), F.count(F.lit(1)).alias("observations"))


def match_outcomes(matches: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Clusters by outcome: accepted, ambiguous (margin too small) or below the threshold."""
    outcome = F.when(F.col("accepted"), "accepted").when(F.col("score") < c.match, "below_threshold").otherwise("ambiguous")
    return matches.groupBy("event_name", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def availability(obs: DataFrame) -> DataFrame:
    """Shares of observations that have faces, bodies, both, and valid vectors."""
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    face, body = F.col("face_embedding").isNotNull(), F.col("body_embedding").isNotNull()
    return obs.groupBy("event_name").agg(rate(face).alias("face_rate"), rate(body).alias("body_rate"), rate(face & body).alias("both_rate"), rate(F.col("face_embedding_valid")).alias("valid_face_rate"), rate(F.col("body_embedding_valid")).alias("valid_body_rate"))


def detection_scores(found: DataFrame, truth: DataFrame, least_iou: float = 0.5) -> DataFrame:
    """Precision and recall of boxes: a truth box counts as found if a detection of its image overlaps it enough."""
    key = ["event_name", "image_id"]
    pairs = found.select(*key, "body_ord", F.col("bbox").alias("f")).join(truth.select(*key, "truth_ord", F.col("bbox").alias("t")), key)
    hits = pairs.where(G.iou(F.col("f"), F.col("t")) >= least_iou)
    of = lambda rows, name, *cols: rows.select(*cols).distinct().groupBy("event_name").agg(F.count(F.lit(1)).alias(name))
    out = of(found, "found", *key, "body_ord").join(of(truth, "truth", *key, "truth_ord"), "event_name", "full").join(of(hits, "right", *key, "body_ord"), "event_name", "left").join(of(hits, "met", *key, "truth_ord"), "event_name", "left")
    rate = lambda a, b: F.when(F.col(b) > 0, F.coalesce(F.col(a), F.lit(0)) / F.col(b))
    return out.select("event_name", rate("right", "found").alias("precision"), rate("met", "truth").alias("recall"))


def pose_distribution(obs: DataFrame) -> DataFrame:
    return obs.groupBy("event_name", Q.known_pose(F.col("face_pose")).alias("pose")).agg(F.count(F.lit(1)).alias("n"), F.avg("face_detection_confidence").alias("mean_confidence"), F.avg(G.short_side(F.col("face_bbox"))).alias("mean_size"))


def isolation_violations(matches: DataFrame, refs: DataFrame) -> DataFrame:
    """Matches whose reference isn't of their own event; must be empty."""
    return matches.where("reference_image is not null").join(refs.select("event_name", F.col("image_path").alias("reference_image")), ["event_name", "reference_image"], "left_anti")


