"""Engine tables made from the synthetic tables, in Spark and - the same arithmetic - in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import quality as Q
from ..functions import vector as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mixed(w: str, a: str, b: str):
    w, a, b = F.col(w), F.col(a), F.col(b)
    return F.zip_with(a, b, lambda x, y: w * x + F.sqrt(1 - w * w) * y)


def _unit(v):
    return V.bound(v, lambda w: V.bound(V.norm(w), lambda n: F.transform(w, lambda x: x / n)))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _vectors(spark, sf_dir)
    # 25 seeds, by construction.
    seeds = F.broadcast(e.where("i < 25").select(F.col("i").alias("p"), F.col("v").alias("s")))
    rows = e.withColumn("p", F.col("i") % 25).join(seeds, "p").withColumn("w", F.lit(0.8) + F.lit(0.03) * (F.col("i") % 6))
    rows = rows.withColumn("face", _unit(_mixed("w", "s", "v")))
    i, ev = F.col("i"), F.floor(F.col("i") / 125).cast("long")
    k = i % 7
    pose = F.when(i % 31 == 0, None).when(k <= 3, "frontal").when(k == 4, "left").when(k == 5, "right").otherwise("profile")
    yaw = F.when(k <= 3, (i % 20).cast("double")).when(k == 4, -35.0).when(k == 5, 35.0).otherwise(70.0)
    x, y, side = (i * 7) % 400, (i * 11) % 300, 30 + (i * 17) % 150
    face_box = G.box(x, y, x + side, y + side)
    body_box = F.when(i % 13 != 0, G.box(x - 10, y - 10, x + side + 60, y + 3 * side))
    out = rows.select(
        F.concat(F.lit("E"), ev.cast("string")).alias("event_name"), i.alias("observation_id"),
        F.concat(F.lit("data/events/E"), ev.cast("string"), F.lit("/Gallery/IMG_"), (i % 75).cast("string"), F.lit(".jpg")).alias("image_id"),
        (i % 25).alias("true_person"), body_box.alias("person_bbox"), face_box.alias("face_bbox"),
        (F.lit(0.4) + F.lit(0.01) * ((i * 7) % 60)).alias("person_detection_confidence"), (F.lit(0.5) + F.lit(0.01) * ((i * 13) % 50)).alias("face_detection_confidence"),
        (F.lit(0.5) + F.lit(0.01) * (i % 50)).alias("association_score"), (F.lit(0.4) + F.lit(0.01) * ((i * 37) % 60)).alias("face_quality"), (F.lit(0.3) + F.lit(0.01) * ((i * 29) % 70)).alias("body_quality"),
        F.lit(True).alias("face_embedding_valid"), (i % 4 != 0).alias("body_embedding_valid"),
        F.col("face").alias("face_embedding"), F.when(i % 11 != 0, F.reverse("face")).alias("body_embedding"),
        F.lit(None).cast("long").alias("moment_id"), F.lit(None).cast("long").alias("cluster_id"), yaw.alias("face_yaw"), pose.alias("face_pose"),
    )
    return out.withColumn("observation_type", Q.observation_type())


def assignments(obs: DataFrame) -> DataFrame:
    """Clusters by true person; three of 25 persons stay unassigned."""
    return obs.select("event_name", "observation_id", F.when(F.col("true_person") < 22, F.col("true_person")).alias("cluster_id"))


def reference_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One face per reference image of persons 0-19 in each event."""
    e = _vectors(spark, sf_dir).where("i < 45")
    rows = e.where("i < 20").select(F.col("i").alias("p"), F.col("v").alias("s")).join(e.select((F.col("i") - 25).alias("p"), "v"), "p")
    events = observations(spark, sf_dir).select("event_name").distinct()
    rows = rows.withColumn("w", F.lit(0.95)).crossJoin(F.broadcast(events))  # 20 persons in every event
    p = F.col("p").cast("string")
    return rows.select(
        "event_name", F.concat(F.lit("Person "), p, F.lit(" - 2010000"), p, F.lit(".jpg")).alias("image_path"), F.lit(0).alias("face_ord"), F.lit(0.9).alias("confidence"),
        _unit(_mixed("w", "s", "v")).alias("embedding"),
    )


def image_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    status = F.when(i % 10 <= 5, "COMPLETED").when(i % 10 == 6, "PROCESSING").when(i % 10 == 7, "FAILED").otherwise("PENDING")
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / F.lit(1e6)
    started = i % 10 <= 7
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("E"), (F.col("user_id") % 4).cast("string")).alias("event_name"), i.alias("job_id"),
        F.concat(F.lit("data/events/E"), (F.col("user_id") % 4).cast("string"), F.lit("/Gallery/JOB_"), i.cast("string"), F.lit(".jpg")).alias("image_id"),
        F.concat(F.lit("/srv/data/events/E"), (F.col("user_id") % 4).cast("string"), F.lit("/Gallery/JOB_"), i.cast("string"), F.lit(".jpg")).alias("image_path"),
        status.alias("status"), F.when(started, F.concat(F.lit("w"), (i % 3).cast("string"))).alias("worker_id"), F.when(started, 1 + i % 2).otherwise(0).alias("attempts"),
        t.alias("created_at"), F.when(started, t).alias("started_at"), F.when((i % 10 <= 5) | (i % 10 == 7), t + 5).alias("completed_at"), F.when(i % 10 == 7, "Could not read image").alias("error_message"),
    )


def faces_and_bodies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Boxes by modular arithmetic on the keys of lineitem; an order is an image of up to seven faces and bodies."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"))
    ord_ = F.row_number().over(Window.partitionBy("k").orderBy("n", "p", "s")) - 1
    rows = rows.withColumn("ord", ord_).select(F.lit("E0").alias("event_name"), F.concat(F.lit("IMG_"), F.col("k").cast("string")).alias("image_id"), "p", "s", F.col("ord").cast("int").alias("ord"))
    p, s = F.col("p"), F.col("s")
    face = G.box(p % 200, s % 100, p % 200 + 20 + p % 40, s % 100 + 20 + p % 40)
    body = G.box((p * 3) % 180, (s * 7) % 80, (p * 3) % 180 + 60 + s % 50, (s * 7) % 80 + 100 + p % 60)
    faces = rows.select("event_name", "image_id", F.col("ord").alias("face_ord"), face.alias("bbox"), (F.lit(0.4) + F.lit(0.01) * (p % 60)).alias("confidence"))
    bodies = rows.select("event_name", "image_id", F.col("ord").alias("body_ord"), body.alias("bbox"), (F.lit(0.3) + F.lit(0.01) * (s % 70)).alias("confidence"), (p % 3).cast("int").alias("class_id"))
    return faces, bodies


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below an events root: galleries, references and others, some not images."""
    i = F.col("page_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Gallery", "reference", "notes")]), (i % 3 + 1).cast("int"))
    ext = F.element_at(F.array(*[F.lit(x) for x in (".jpg", ".JPEG", ".avif", ".gif", ".Png", ".txt", "")]), (i % 7 + 1).cast("int"))
    name = F.concat(F.lit("Ann  Lee "), (i % 5).cast("string"), F.lit(" - 4"), i.cast("string"), ext)
    path = F.concat(F.lit("/srv/data/events/E"), (i % 4).cast("string"), F.lit("/"), kind, F.lit("/"), name)
    return table(spark, sf_dir, "pages").select(i.alias("page_id"), path.alias("path"), "url")


#: The same tables as common table expressions: sides of boxes are columns, as DuckDB's output has no use for structs.
SQL = """
e AS (SELECT vec_id AS i, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
blended AS (SELECT e.i, s.v AS sv, e.v AS v, 0.8::DOUBLE + 0.03::DOUBLE * (e.i % 6) AS w FROM e JOIN e s ON s.i = e.i % 25),
raw AS (SELECT i, list_transform(list_zip(sv, v), lambda p: w * p[1] + sqrt(1 - w * w) * p[2]) AS m FROM blended),
unit AS (SELECT i, list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS face FROM raw),
obs AS (
  SELECT 'E' || (i // 125) AS event_name, i AS observation_id, 'data/events/E' || (i // 125) || '/Gallery/IMG_' || (i % 75) || '.jpg' AS image_id, i % 25 AS true_person,
    CASE WHEN i % 13 <> 0 THEN (i * 7) % 400 - 10 END AS px1, CASE WHEN i % 13 <> 0 THEN (i * 11) % 300 - 10 END AS py1,
    CASE WHEN i % 13 <> 0 THEN (i * 7) % 400 + 30 + (i * 17) % 150 + 60 END AS px2, CASE WHEN i % 13 <> 0 THEN (i * 11) % 300 + 3 * (30 + (i * 17) % 150) END AS py2,
    (i * 7) % 400 AS fx1, (i * 11) % 300 AS fy1, (i * 7) % 400 + 30 + (i * 17) % 150 AS fx2, (i * 11) % 300 + 30 + (i * 17) % 150 AS fy2, 30 + (i * 17) % 150 AS face_side,
    0.4::DOUBLE + 0.01::DOUBLE * ((i * 7) % 60) AS person_detection_confidence, 0.5::DOUBLE + 0.01::DOUBLE * ((i * 13) % 50) AS face_detection_confidence,
    0.5::DOUBLE + 0.01::DOUBLE * (i % 50) AS association_score, 0.4::DOUBLE + 0.01::DOUBLE * ((i * 37) % 60) AS face_quality, 0.3::DOUBLE + 0.01::DOUBLE * ((i * 29) % 70) AS body_quality,
    true AS face_embedding_valid, i % 4 <> 0 AS body_embedding_valid, face AS face_embedding, CASE WHEN i % 11 <> 0 THEN list_reverse(face) END AS body_embedding,
    CASE WHEN i % 7 <= 3 THEN (i % 20)::DOUBLE WHEN i % 7 = 4 THEN -35.0::DOUBLE WHEN i % 7 = 5 THEN 35.0::DOUBLE ELSE 70.0::DOUBLE END AS face_yaw,
    CASE WHEN i % 31 = 0 THEN NULL WHEN i % 7 <= 3 THEN 'frontal' WHEN i % 7 = 4 THEN 'left' WHEN i % 7 = 5 THEN 'right' ELSE 'profile' END AS face_pose
  FROM unit),
prepared AS (
  SELECT event_name, observation_id, image_id, face_pose AS pose, face_embedding AS face, CASE WHEN body_embedding_valid THEN body_embedding END AS body,
    0.7::DOUBLE * face_quality + 0.3::DOUBLE * face_detection_confidence AS quality,
    coalesce(face_pose = 'frontal' AND face_quality >= 0.5 AND face_detection_confidence >= 0.5 AND face_side >= 40 AND abs(face_yaw) <= 20, false) AS anchor
  FROM obs),
assign AS (SELECT event_name, observation_id, CASE WHEN true_person < 22 THEN true_person END AS cluster_id FROM obs),
member AS (SELECT o.*, a.cluster_id FROM obs o JOIN assign a USING (event_name, observation_id) WHERE a.cluster_id IS NOT NULL),
ref_raw AS (SELECT s.i AS p, list_transform(list_zip(s.v, o.v), lambda q: 0.95::DOUBLE * q[1] + sqrt(1 - 0.95::DOUBLE * 0.95::DOUBLE) * q[2]) AS m FROM e s JOIN e o ON o.i = s.i + 25 WHERE s.i < 20),
refs AS (
  SELECT event_name, 'Person ' || p || ' - 2010000' || p || '.jpg' AS image_path, 'Person ' || p AS person_name, '2010000' || p AS phone_number,
    list_transform(m, lambda x: x / sqrt(list_dot_product(m, m))) AS embedding, row_number() OVER (PARTITION BY event_name ORDER BY 'Person ' || p || ' - 2010000' || p || '.jpg') AS reference_ord
  FROM ref_raw CROSS JOIN (SELECT DISTINCT event_name FROM obs)),
jobs AS (
  SELECT 'E' || (user_id % 4) AS event_name, event_id AS job_id, 'data/events/E' || (user_id % 4) || '/Gallery/JOB_' || event_id || '.jpg' AS image_id, '/srv/data/events/E' || (user_id % 4) || '/Gallery/JOB_' || event_id || '.jpg' AS image_path,
    CASE WHEN event_id % 10 <= 5 THEN 'COMPLETED' WHEN event_id % 10 = 6 THEN 'PROCESSING' WHEN event_id % 10 = 7 THEN 'FAILED' ELSE 'PENDING' END AS status,
    CASE WHEN event_id % 10 <= 7 THEN 'w' || (event_id % 3) END AS worker_id, CASE WHEN event_id % 10 <= 7 THEN 1 + event_id % 2 ELSE 0 END AS attempts,
    epoch_us(ts) / 1e6 AS created_at, CASE WHEN event_id % 10 <= 7 THEN epoch_us(ts) / 1e6 END AS started_at,
    CASE WHEN event_id % 10 <= 5 OR event_id % 10 = 7 THEN epoch_us(ts) / 1e6 + 5 END AS completed_at, CASE WHEN event_id % 10 = 7 THEN 'Could not read image' END AS error_message
  FROM events),
boxes AS (SELECT 'E0' AS event_name, 'IMG_' || l_orderkey AS image_id, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS ord FROM lineitem),
faces AS (SELECT event_name, image_id, ord AS face_ord, p % 200 AS x1, s % 100 AS y1, p % 200 + 20 + p % 40 AS x2, s % 100 + 20 + p % 40 AS y2, 0.4::DOUBLE + 0.01::DOUBLE * (p % 60) AS confidence FROM boxes),
bodies AS (
  SELECT event_name, image_id, ord AS body_ord, (p * 3) % 180 AS x1, (s * 7) % 80 AS y1, (p * 3) % 180 + 60 + s % 50 AS x2, (s * 7) % 80 + 100 + p % 60 AS y2, 0.3::DOUBLE + 0.01::DOUBLE * (s % 70) AS confidence, p % 3 AS class_id
  FROM boxes),
files AS (
  SELECT page_id, url, '/srv/data/events/E' || (page_id % 4) || '/' || (['Gallery', 'reference', 'notes'])[page_id % 3 + 1] || '/Ann  Lee ' || (page_id % 5) || ' - 4' || page_id
    || (['.jpg', '.JPEG', '.avif', '.gif', '.Png', '.txt', ''])[page_id % 7 + 1] AS path
  FROM pages)
"""


def sql(select: str, *ctes: str) -> str:
    return f"WITH {SQL.strip()}{''.join(f', {c}' for c in ctes)} {select}"
