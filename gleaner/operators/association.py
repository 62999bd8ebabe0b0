"""Faces and bodies of an image, one to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import geometry as G


def association_scores(faces: DataFrame, bodies: DataFrame) -> DataFrame:
    """Every face with every body of its image, and how well they fit.  An image holds a handful of each."""
    pairs = faces.select("event_name", "image_id", "face_ord", F.col("bbox").alias("face")).join(bodies.select("event_name", "image_id", "body_ord", F.col("bbox").alias("body")), ["event_name", "image_id"])
    return pairs.withColumn("score", G.association(F.col("face"), F.col("body")))


def associate(faces: DataFrame, bodies: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Full outer, greedy, 1:1: in order of face_ord each face takes the best unused body, if it fits well enough.

    One row per face, then one per body left over: event_name, image_id, ord, face_ord, body_ord, association_score.
    The order in which faces choose is a fold over the image's faces, carrying the bodies taken.
    """
    fits = association_scores(faces, bodies).where("score > 0").groupBy("event_name", "image_id", "face_ord").agg(F.collect_list(F.struct("score", (-F.col("body_ord")).alias("back"))).alias("fits"))
    per_face = faces.select("event_name", "image_id", "face_ord").join(fits, ["event_name", "image_id", "face_ord"], "left")
    images = per_face.groupBy("event_name", "image_id").agg(F.sort_array(F.collect_list(F.struct("face_ord", "fits"))).alias("faces"))

    def choose(state, face):
        free = F.filter(F.coalesce(face["fits"], F.array().cast("array<struct<score:double,back:int>>")), lambda f: ~F.array_contains(state["used"], -f["back"]))
        best = F.array_max(free)
        body = F.when(best["score"] >= c.association, -best["back"])
        row = F.struct(face["face_ord"].alias("face_ord"), body.alias("body_ord"), F.when(body.isNotNull(), best["score"]).otherwise(0.0).alias("score"))
        used = F.when(body.isNotNull(), F.concat(state["used"], F.array(body))).otherwise(state["used"])
        return F.struct(used.alias("used"), F.concat(state["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<face_ord:int,body_ord:int,score:double>>").alias("rows"))
    matched = images.select("event_name", "image_id", F.inline(F.aggregate("faces", start, choose)["rows"]))
    left = bodies.select("event_name", "image_id", "body_ord").join(matched.where("body_ord is not null"), ["event_name", "image_id", "body_ord"], "left_anti")
    left = left.select("event_name", "image_id", F.lit(None).cast("int").alias("face_ord"), "body_ord", F.lit(0.0).alias("score"))
    return matched.unionByName(left).withColumnRenamed("score", "association_score")


def detections(raw: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Detections of persons that are certain enough."""
    return raw.where((F.col("confidence") >= c.detection) & (F.col("class_id") == c.person_class))
