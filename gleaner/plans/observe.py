"""Detections to observations: the per-image part of the engine, with models behind plain functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import geometry as G
from ..functions import images as I
from ..functions import quality as Q
from ..functions import vector as V
from ..operators import association
from ..sources import files

_BOX = "struct<x1:int,y1:int,x2:int,y2:int>"
SCHEMA = f"kind string, ord int, bbox {_BOX}, confidence double, class_id int, landmarks array<array<double>>, embedding array<float>, sharpness double"


def detect(images: DataFrame, decode: Callable[[bytes], np.ndarray], persons: Callable, faces: Callable, encode: Callable) -> DataFrame:
    """One row per face and person of each image, and one with `error` per image that failed.

    persons(image) and faces(image) give dicts of bbox, confidence and, for faces, landmarks and embedding; encode(image,
    boxes) gives a vector or None per box, one call per image.
    """

    def crop(image, b, share=1.0):
        h, w = image.shape[:2]
        x1, y1, x2, y2 = max(0, b[0]), max(0, b[1]), min(w, b[2]), min(h, b[3])
        return image[y1 : y1 + max(1, int((y2 - y1) * share)), x1:x2] if x2 > x1 and y2 > y1 else image[:0, :0]

    def run(image, _):
        out = []
        people = persons(image)
        for n, (p, v) in enumerate(zip(people, encode(image, [p["bbox"] for p in people]), strict=True)):
            out.append(_row("body", n, p, v, I.sharpness(crop(image, p["bbox"]))))
        for n, f in enumerate(faces(image)):
            out.append(_row("face", n, f, f["embedding"], I.sharpness(crop(image, f["bbox"]))))
        return out or [{"kind": "none"}]

    return files.decoded(images, decode, run, SCHEMA)


def _row(kind: str, n: int, d: dict, v, sharp: float) -> dict:
    box = dict(zip(("x1", "y1", "x2", "y2"), (int(x) for x in d["bbox"]), strict=True))
    return {"kind": kind, "ord": n, "bbox": box, "confidence": float(d["confidence"]), "class_id": int(d.get("class_id", 0)), "landmarks": d.get("landmarks"), "embedding": None if v is None else [float(x) for x in v], "sharpness": float(sharp)}


def observe(found: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Observations of detected faces and bodies: associated, rated, checked, numbered per event by image."""
    found = found.where("error is null")
    faces = found.where("kind = 'face'").withColumn("face_ord", F.col("ord"))
    bodies = association.detections(found.where("kind = 'body'"), c).withColumn("body_ord", F.col("ord"))
    pairs = association.associate(faces, bodies, c)
    f = faces.select("event_name", "image_id", "face_ord", F.col("bbox").alias("face_bbox"), F.col("confidence").alias("face_detection_confidence"), F.col("embedding").alias("face_vector"), F.col("sharpness").alias("face_sharpness"), "landmarks")
    b = bodies.select("event_name", "image_id", "body_ord", F.col("bbox").alias("person_bbox"), F.col("confidence").alias("person_detection_confidence"), F.col("embedding").alias("body_vector"), F.col("sharpness").alias("body_sharpness"))
    rows = pairs.join(f, ["event_name", "image_id", "face_ord"], "left").join(b, ["event_name", "image_id", "body_ord"], "left")
    pose = I.head_pose_of(F.col("landmarks"))
    rows = rows.withColumn("face_embedding", V.normalise_or_keep(F.col("face_vector")).cast("array<float>")).withColumn("body_embedding", V.normalise(F.col("body_vector")).cast("array<float>")).withColumn("p", F.when(F.col("landmarks").isNotNull(), pose))
    order = Window.partitionBy("event_name").orderBy("image_id", F.col("face_ord").asc_nulls_last(), "body_ord")
    return rows.withColumn("observation_id", F.row_number().over(order).cast("long") - 1).select(
        "event_name", "observation_id", "image_id", Q.observation_type().alias("observation_type"), "person_bbox", "face_bbox", "person_detection_confidence", "face_detection_confidence", "association_score",
        Q.detection_quality(F.col("face_bbox"), F.col("face_detection_confidence"), F.col("face_sharpness"), c.face).alias("face_quality"),
        Q.detection_quality(F.col("person_bbox"), F.col("person_detection_confidence"), F.col("body_sharpness"), c.body).alias("body_quality"),
        V.is_valid(F.col("face_embedding")).alias("face_embedding_valid"), V.is_valid(F.col("body_embedding")).alias("body_embedding_valid"), "face_embedding", "body_embedding",
        F.lit(None).cast("long").alias("moment_id"), F.lit(None).cast("long").alias("cluster_id"),
        F.col("p.yaw").alias("face_yaw"), F.col("p.pitch").alias("face_pitch"), F.col("p.roll").alias("face_roll"), Q.pose_of_yaw(F.col("p.yaw"), c).alias("face_pose"),
    )


def reference_faces(images: DataFrame, decode: Callable[[bytes], np.ndarray], faces: Callable) -> DataFrame:
    """Faces of reference images, for matching.references: event_name, image_path, face_ord, bbox, confidence, embedding.

    images: event_name, image_path, content.  Images that can't be read and those without a face give no row; their names
    still count for matching.contacts.
    """
    run = lambda image, _: [{k: v for k, v in _row("face", n, f, f["embedding"], 0.0).items() if k in ("ord", "bbox", "confidence", "embedding")} for n, f in enumerate(faces(image))]
    found = files.decoded(images.withColumnRenamed("image_path", "image_id"), decode, run, f"ord int, bbox {_BOX}, confidence double, embedding array<float>")
    return found.where("error is null").select("event_name", F.col("image_id").alias("image_path"), F.col("ord").alias("face_ord"), "bbox", "confidence", "embedding")


def failures(found: DataFrame) -> DataFrame:
    """Images that could not be worked on."""
    return found.where("error is not null").select("event_name", "image_id", "error").distinct()


def upper_bodies(obs: DataFrame, image_width: int, image_height: int, c: Config = DEFAULT) -> DataFrame:
    return obs.withColumn("upper_body", G.upper_body(F.col("person_bbox"), F.lit(image_width), F.lit(image_height), c.upper_body))
