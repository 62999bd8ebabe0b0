"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = T.StructType([T.StructField(c, T.IntegerType()) for c in ("x1", "y1", "x2", "y2")])
VECTOR = T.ArrayType(T.FloatType())

OBSERVATIONS = T.StructType([
    T.StructField("event_name", T.StringType()), T.StructField("observation_id", T.LongType()), T.StructField("image_id", T.StringType()),
    T.StructField("observation_type", T.StringType()), T.StructField("person_bbox", BOX), T.StructField("face_bbox", BOX),
    T.StructField("person_detection_confidence", T.DoubleType()), T.StructField("face_detection_confidence", T.DoubleType()),
    T.StructField("association_score", T.DoubleType()), T.StructField("face_quality", T.DoubleType()), T.StructField("body_quality", T.DoubleType()),
    T.StructField("face_embedding_valid", T.BooleanType()), T.StructField("body_embedding_valid", T.BooleanType()),
    T.StructField("face_embedding", VECTOR), T.StructField("body_embedding", VECTOR),
    T.StructField("moment_id", T.LongType()), T.StructField("cluster_id", T.LongType()),
    T.StructField("face_yaw", T.DoubleType()), T.StructField("face_pitch", T.DoubleType()), T.StructField("face_roll", T.DoubleType()), T.StructField("face_pose", T.StringType()),
])

IMAGE_JOBS = T.StructType([
    T.StructField("event_name", T.StringType()), T.StructField("job_id", T.LongType()), T.StructField("image_id", T.StringType()), T.StructField("image_path", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("worker_id", T.StringType()), T.StructField("attempts", T.LongType()),
    T.StructField("created_at", T.DoubleType()), T.StructField("started_at", T.DoubleType()), T.StructField("completed_at", T.DoubleType()), T.StructField("error_message", T.StringType()),
])

MATCHES = "event_name string, cluster_id long, person_name string, similarity double, margin double, reference_image string, matched_at double"

FACE = T.StructType([T.StructField("bbox", BOX), T.StructField("confidence", T.DoubleType()), T.StructField("landmarks", T.ArrayType(T.ArrayType(T.DoubleType()))), T.StructField("embedding", VECTOR)])
PERSON = T.StructType([T.StructField("bbox", BOX), T.StructField("confidence", T.DoubleType())])
