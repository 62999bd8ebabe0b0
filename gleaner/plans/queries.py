"""One query per operator, over the synthetic tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT as C
from ..functions import geometry as G
from ..functions import paths as P
from ..functions import quality as Q
from ..functions import vector as V
from ..operators import association, clustering, evaluate, jobs, matching, scoring, selection, state
from . import fixtures as X
from .fixtures import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = 1.8e9
KEY = ("event_name", "observation_id")


def rounded(c: str | Column, digits: int) -> Column:
    """As the SQL rounds doubles: the product with 10 ** digits, half away from zero; a double's decimals would meet other ties."""
    scale = float(10**digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * F.lit(scale), 0) / F.lit(scale)


def r8(c: str | Column) -> Column:
    return rounded(c, 8)


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


def r4(c: str | Column) -> Column:
    return rounded(c, 4)


# Sources


@query("src_events", sql("SELECT DISTINCT 'E' || (page_id % 4) AS event_name FROM files"))
def _(spark, d):
    found = X.paths(spark, d).select(P.event_of(F.col("path")).alias("event_name"))
    return found.where("event_name is not null").distinct().orderBy(F.lower("event_name"))


@query("src_gallery", sql("SELECT page_id, path, lower(regexp_extract(path, '\\.[^./]+$')) AS ext FROM files WHERE path LIKE '%/Gallery/%' AND page_id % 7 IN (0, 1, 2, 4)"))
def _(spark, d):
    p = F.col("path")
    return X.paths(spark, d).where(P.in_folder(p, "Gallery") & P.is_image(p)).select("page_id", "path", P.extension(p).alias("ext"))


@query("src_references", sql("SELECT 'E' || (page_id % 4) AS event_name, path, row_number() OVER (PARTITION BY page_id % 4 ORDER BY path) AS reference_ord FROM files WHERE path LIKE '%/reference/%' AND page_id % 7 IN (0, 1, 4)"))
def _(spark, d):
    p = F.col("path")
    rows = X.paths(spark, d).where(P.in_folder(p, "reference") & P.is_image(p, reference=True)).select(P.event_of(p).alias("event_name"), "path")
    return rows.withColumn("reference_ord", F.row_number().over(Window.partitionBy("event_name").orderBy("path")).cast("long"))


@query("src_observations", sql("SELECT event_name, observation_id, image_id, CASE WHEN body_embedding IS NULL THEN 'face_only' ELSE 'face_and_body' END AS observation_type, round(face_quality, 4) AS face_quality, face_pose, len(face_embedding) AS dimension FROM obs"))
def _(spark, d):
    rows = X.observations(spark, d).orderBy("observation_id")
    return rows.select("event_name", "observation_id", "image_id", "observation_type", r4("face_quality").alias("face_quality"), "face_pose", F.size("face_embedding").cast("long").alias("dimension"))


@query("src_failed_jobs", sql("SELECT event_name, job_id, image_id, attempts, error_message FROM jobs WHERE status = 'FAILED'"))
def _(spark, d):
    return jobs.failed(X.image_jobs(spark, d))


@query("src_env_lines", "SELECT page_id, 'KEY_' || page_id AS key, url AS value FROM pages WHERE page_id % 3 = 0")
def _(spark, d):
    from ..sources.settings import env_rows

    i = F.col("page_id")
    line = F.when(i % 3 == 0, F.concat(F.lit(" KEY_"), i.cast("string"), F.lit(" = \""), F.col("url"), F.lit('"'))).when(i % 3 == 1, F.concat(F.lit("# "), F.col("url"))).otherwise(F.lit("no pair"))
    return env_rows(X.table(spark, d, "pages").select("page_id", line.alias("value")))


@query("src_log_tail", "SELECT doc_id, right(text, 500) AS tail, CASE WHEN length(text) > 12000 THEN 12000 ELSE length(text) END AS seen FROM documents")
def _(spark, d):
    t = F.col("text")
    return X.table(spark, d, "documents").select("doc_id", jobs.log_tail(t, 500).alias("tail"), F.length(jobs.log_tail(t, 12000)).cast("long").alias("seen"))


@query("qs_phase", "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'complete' WHEN 1 THEN 'output' WHEN 2 THEN 'reference_matching' WHEN 3 THEN 'clustering' ELSE 'image_processing' END AS phase FROM documents")
def _(spark, d):
    marks = F.array(*[F.lit(x) for x in ("Processing complete", "generating final output", "Event reference matching", "Constrained identity clustering", "image 3 of 9")])
    text = F.concat(F.col("text"), F.lit("\n"), F.element_at(marks, (F.col("doc_id") % 5 + 1).cast("int")))
    return X.table(spark, d, "documents").select("doc_id", jobs.phase_of(text).alias("phase"))


# Filters and projections


@query("flt_valid_face", sql("SELECT event_name, observation_id FROM obs WHERE face_embedding_valid AND len(face_embedding) > 0 AND observation_id % 9 <> 4"))
def _(spark, d):
    i = F.col("observation_id")
    broken = F.when(i % 18 == 4, F.transform("face_embedding", lambda x: x * 0)).when(i % 9 == 4, F.transform("face_embedding", lambda x: F.lit(float("nan")))).otherwise(F.col("face_embedding"))
    return X.observations(spark, d).withColumn("face_embedding", broken).where(Q.is_valid_face()).select(*KEY)


@query("flt_embedding_validity", "SELECT vec_id, vec_id % 5 = 0 AS valid FROM embeddings")
def _(spark, d):
    i, e = F.col("vec_id"), F.col("embedding")
    inf = F.transform(e, lambda x: F.lit(float("inf")))
    v = F.when(i % 5 == 0, e).when(i % 5 == 1, F.transform(e, lambda x: F.lit(0.0))).when(i % 5 == 2, inf).when(i % 5 == 3, F.array().cast("array<double>"))
    return X.table(spark, d, "embeddings").select("vec_id", V.is_valid(v).alias("valid"))


@query("flt_anchors", sql("SELECT event_name, observation_id, anchor FROM prepared"))
def _(spark, d):
    return X.observations(spark, d).select(*KEY, Q.is_anchor(C).alias("anchor"))


@query("flt_cluster_anchors", sql("SELECT p.event_name, a.cluster_id, bool_or(p.anchor) AS has_anchor, count(*) FILTER (WHERE p.anchor) AS anchors FROM prepared p JOIN assign a USING (event_name, observation_id) WHERE a.cluster_id IS NOT NULL GROUP BY ALL"))
def _(spark, d):
    obs = X.observations(spark, d)
    rows = selection.members(obs, X.assignments(obs)).withColumn("anchor", Q.is_anchor(C))
    return rows.groupBy("event_name", "cluster_id").agg(F.bool_or("anchor").alias("has_anchor"), F.count_if("anchor").alias("anchors"))


@query("flt_cross_pose", sql("SELECT a.observation_id AS a, b.observation_id AS b, coalesce(a.face_pose <> b.face_pose, false) AS cross_pose FROM obs a JOIN obs b ON b.observation_id = a.observation_id + 1"))
def _(spark, d):
    o = X.observations(spark, d).select("observation_id", "face_pose")
    b = o.select((F.col("observation_id") - 1).alias("a"), F.col("observation_id").alias("b"), F.col("face_pose").alias("pose_b"))
    return o.withColumnRenamed("observation_id", "a").join(b, "a").select("a", "b", Q.is_cross_pose(F.col("face_pose"), F.col("pose_b")).alias("cross_pose"))


@query("flt_detections", sql("SELECT event_name, image_id, body_ord::INTEGER AS body_ord, round(confidence, 4) AS confidence FROM bodies WHERE confidence >= 0.4 AND class_id = 0"))
def _(spark, d):
    return association.detections(X.faces_and_bodies(spark, d)[1], C).select("event_name", "image_id", "body_ord", r4("confidence").alias("confidence"))


@query("flt_safe_paths", sql("SELECT page_id, page_id % 4 = 0 AS safe FROM files"))
def _(spark, d):
    i = F.col("page_id")
    p = F.when(i % 4 == 0, "All Images/a..b.jpg").when(i % 4 == 1, "../up.jpg").when(i % 4 == 2, "/abs.jpg").otherwise("a/../b.jpg")
    return X.paths(spark, d).select("page_id", P.is_safe_relative(p).alias("safe"))


@query("prj_observation_type", sql("SELECT CASE WHEN f AND b THEN 'face_and_body' WHEN f THEN 'face_only' WHEN b THEN 'body_only' ELSE 'empty' END AS observation_type, count(*) AS n FROM (SELECT observation_id % 3 <> 0 AS f, body_embedding IS NOT NULL AS b FROM obs) GROUP BY 1"))
def _(spark, d):
    rows = X.observations(spark, d).withColumn("face_embedding", F.when(F.col("observation_id") % 3 != 0, F.col("face_embedding")))
    return rows.groupBy(Q.observation_type().alias("observation_type")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_boxes", sql("SELECT event_name, observation_id, px1::INTEGER AS person_x1, py1::INTEGER AS person_y1, px2::INTEGER AS person_x2, py2::INTEGER AS person_y2, px1 IS NOT NULL AS has_box FROM obs"))
def _(spark, d):
    flat = X.observations(spark, d).select(*KEY, *G.sides(F.col("person_bbox"), "person"))
    again = G.box(*[F.col(f"person_{s}") for s in G.FIELDS])
    return flat.withColumn("has_box", again.isNotNull())


@query("prj_embedding_bytes", "SELECT vec_id, (4 * len(embedding))::INTEGER AS bytes, true AS same FROM embeddings")
def _(spark, d):
    from ..sources.blobs import decode, encode

    rows = X.table(spark, d, "embeddings").select("vec_id", "embedding", encode("embedding").alias("blob"))
    back = rows.withColumn("back", decode(F.col("blob"), F.size("embedding")))
    return back.select("vec_id", F.length("blob").alias("bytes"), (F.col("back") == F.col("embedding")).alias("same"))


@query("prj_renumber", sql("SELECT event_name, image_id, 1000 + row_number() OVER (PARTITION BY event_name ORDER BY image_id, observation_id) - 1 AS observation_id FROM obs"))
def _(spark, d):
    new = X.observations(spark, d).select("event_name", "image_id", F.col("observation_id").alias("local_ord"))
    first = new.select("event_name", F.lit(1000).alias("next_id")).distinct()
    return jobs.renumber(new, first).select("event_name", "image_id", "observation_id")


# Pair scores and joins

#: Bodies are reversed faces, so their inner product is that of the faces.
_PAIRS = """sims AS (
  SELECT a.event_name, a.observation_id AS observation_id_a, b.observation_id AS observation_id_b, a.pose AS pose_a, b.pose AS pose_b, (a.quality + b.quality) / 2 AS q,
    greatest(-1.0, least(1.0, list_dot_product(a.face, b.face))) AS face, CASE WHEN a.body IS NOT NULL AND b.body IS NOT NULL THEN greatest(-1.0, least(1.0, list_dot_product(a.face, b.face))) END AS body, coalesce(a.pose <> b.pose, false) AS cross_pose,
    a.anchor OR b.anchor AS anchored
  FROM prepared a JOIN prepared b ON a.event_name = b.event_name AND a.observation_id < b.observation_id AND a.image_id <> b.image_id),
scores AS (
  SELECT *, CASE WHEN face < CASE WHEN cross_pose THEN 0.60 ELSE 0.55 END THEN NULL WHEN cross_pose AND total < 0.75 THEN NULL ELSE total END AS score
  FROM (SELECT *, greatest(0.0, least(1.0, CASE WHEN body IS NOT NULL THEN 0.65 * face + 0.20 * greatest(0.0, least(1.0, (body + 1) / 2)) + 0.15 * q ELSE 0.75 * face + 0.25 * q END)) AS total FROM sims)),
pairs AS (SELECT * FROM scores WHERE score IS NOT NULL AND anchored)"""


def _pairs(spark, d) -> DataFrame:
    return scoring.pair_scores(scoring.prepared(X.observations(spark, d), C), C)


@query("jn_pair_scores", sql("SELECT event_name, observation_id_a, observation_id_b, round(face, 4) AS face_similarity, round(body, 4) AS body_similarity, cross_pose, round(score, 4) AS score FROM pairs", _PAIRS))
def _(spark, d):
    return _pairs(spark, d).select("event_name", "observation_id_a", "observation_id_b", r4("face_similarity").alias("face_similarity"), r4("body_similarity").alias("body_similarity"), "cross_pose", r4("score").alias("score"))


@query("ag_cluster_pair_scores", sql("SELECT p.event_name, least(a.cluster_id, b.cluster_id) AS cluster_1, greatest(a.cluster_id, b.cluster_id) AS cluster_2, round(max(p.score), 4) AS score FROM pairs p JOIN assign a ON a.observation_id = p.observation_id_a JOIN assign b ON b.observation_id = p.observation_id_b WHERE a.cluster_id <> b.cluster_id GROUP BY ALL", _PAIRS.replace("0.60 ELSE 0.55", "0.10 ELSE 0.05").replace("total < 0.75", "total < 0.20")))
def _(spark, d):
    loose = replace(C, min_face=0.05, cross_face=0.10, cross_merge=0.20)
    obs = X.observations(spark, d)
    scores = scoring.pair_scores(scoring.prepared(obs, loose), loose)
    return scoring.cluster_pair_scores(scores, X.assignments(obs).where("cluster_id is not null")).withColumn("score", r4("score"))


_FIT = """fit AS (
  SELECT *, CASE WHEN barea <= 0 THEN 0.0 WHEN (f1 + f3) / 2.0 BETWEEN b1 AND b3 AND (f2 + f4) / 2.0 BETWEEN b2 AND b4 THEN 0.5 + 0.5 * share ELSE share END::DOUBLE AS score
  FROM (SELECT *, CASE WHEN farea > 0 THEN inter / farea ELSE 0 END AS share
  FROM (SELECT f.event_name, f.image_id, f.face_ord, b.body_ord, f.x1 AS f1, f.y1 AS f2, f.x2 AS f3, f.y2 AS f4, b.x1 AS b1, b.y1 AS b2, b.x2 AS b3, b.y2 AS b4,
    greatest(0, f.x2 - f.x1) * greatest(0, f.y2 - f.y1) AS farea, greatest(0, b.x2 - b.x1) * greatest(0, b.y2 - b.y1) AS barea,
    greatest(0, least(f.x2, b.x2) - greatest(f.x1, b.x1)) * greatest(0, least(f.y2, b.y2) - greatest(f.y1, b.y1)) AS inter
  FROM faces f JOIN bodies b USING (event_name, image_id))))"""


@query("jn_association_scores", sql("SELECT event_name, image_id, face_ord::INTEGER AS face_ord, body_ord::INTEGER AS body_ord, round(score, 8) AS score FROM fit", _FIT))
def _(spark, d):
    return association.association_scores(*X.faces_and_bodies(spark, d)).select("event_name", "image_id", "face_ord", "body_ord", r8("score").alias("score"))


_ASSOCIATE = sql(
    "SELECT event_name, image_id, face_ord::INTEGER AS face_ord, body_ord::INTEGER AS body_ord, round(coalesce(score, 0), 8) AS association_score FROM taken WHERE face_ord IS NOT NULL "
    "UNION ALL SELECT event_name, image_id, NULL, body_ord::INTEGER, 0.0 FROM bodies b WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.image_id = b.image_id AND t.body_ord = b.body_ord)",
    _FIT,
    # RECURSIVE at the head of the statement covers this one
    """step(event_name, image_id, face_ord, body_ord, score, used) AS (
  SELECT event_name, image_id, -1::BIGINT, NULL::BIGINT, NULL::DOUBLE, []::BIGINT[] FROM (SELECT DISTINCT event_name, image_id FROM faces)
  UNION ALL
  SELECT event_name, image_id, face_ord, body_ord, score, CASE WHEN body_ord IS NULL THEN used ELSE list_append(used, body_ord) END FROM (
    SELECT s.event_name, s.image_id, f.face_ord, CASE WHEN x.score >= 0.3 THEN x.body_ord END AS body_ord, CASE WHEN x.score >= 0.3 THEN x.score END AS score, s.used,
      row_number() OVER (PARTITION BY s.image_id ORDER BY x.score DESC NULLS LAST, x.body_ord) AS nth
    FROM step s JOIN faces f ON f.image_id = s.image_id AND f.face_ord = s.face_ord + 1
    LEFT JOIN fit x ON x.image_id = f.image_id AND x.face_ord = f.face_ord AND x.score > 0 AND NOT list_contains(s.used, x.body_ord)) WHERE nth = 1),
taken AS (SELECT * FROM step WHERE face_ord >= 0)""",
).replace("WITH ", "WITH RECURSIVE ", 1)


@query("jn_association", _ASSOCIATE)
def _(spark, d):
    return association.associate(*X.faces_and_bodies(spark, d), C).withColumn("association_score", r8("association_score"))


_MATCH = """sims AS (
  SELECT m.event_name, m.cluster_id, m.observation_id, r.person_name, r.image_path, r.reference_ord, list_dot_product(m.face_embedding, r.embedding) AS score
  FROM member m JOIN refs r USING (event_name)),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_name, cluster_id, person_name ORDER BY score DESC, reference_ord, observation_id) AS nth FROM sims) WHERE nth = 1),
ranked AS (
  SELECT *, row_number() OVER w AS place, score - lead(score, 1, -1.0) OVER w AS margin, count(*) OVER (PARTITION BY event_name, cluster_id) AS candidate_count
  FROM top WINDOW w AS (PARTITION BY event_name, cluster_id ORDER BY score DESC, lower(person_name))),
matches AS (
  SELECT event_name, cluster_id, person_name, score, margin, image_path AS reference_image, score >= 0.55 AND (candidate_count = 1 OR margin >= 0.02) AS accepted, candidate_count
  FROM ranked WHERE place = 1)"""


def _refs(spark, d):
    return matching.references(X.reference_faces(spark, d))


def _matches(spark, d) -> DataFrame:
    obs = X.observations(spark, d)
    return matching.match_clusters(obs, X.assignments(obs), _refs(spark, d), C)


@query("jn_reference_similarities", sql("SELECT event_name, cluster_id, observation_id, person_name, image_path, reference_ord, round(score, 4) AS score FROM sims", _MATCH))
def _(spark, d):
    obs = X.observations(spark, d)
    out = matching.similarities(obs, X.assignments(obs), _refs(spark, d))
    return out.select("event_name", "cluster_id", "observation_id", "person_name", "image_path", F.col("reference_ord").cast("long").alias("reference_ord"), r4("score").alias("score"))


@query("ag_best_references", sql("SELECT event_name, cluster_id, person_name, image_path AS reference_image, round(score, 4) AS score FROM top", _MATCH))
def _(spark, d):
    obs = X.observations(spark, d)
    return matching.best_references(matching.similarities(obs, X.assignments(obs), _refs(spark, d))).withColumn("score", r4("score"))


@query("match_clusters", sql("SELECT event_name, cluster_id, person_name, round(score, 4) AS score, round(margin, 4) AS margin, reference_image, accepted, candidate_count FROM matches", _MATCH))
def match_clusters(spark, d):
    return _matches(spark, d).withColumn("score", r4("score")).withColumn("margin", r4("margin"))


@query("match_references", sql("SELECT event_name, image_path, person_name, phone_number, reference_ord FROM refs"))
def _(spark, d):
    return _refs(spark, d).select("event_name", "image_path", "person_name", "phone_number", F.col("reference_ord").cast("long").alias("reference_ord"))


@query("wn_reference_face", sql("SELECT event_name, image_id, face_ord::INTEGER AS face_ord, round(confidence, 4) AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY event_name, image_id ORDER BY confidence DESC, face_ord) AS nth FROM faces) WHERE nth = 1"))
def _(spark, d):
    first = Window.partitionBy("event_name", "image_id").orderBy(F.desc("confidence"), "face_ord")
    rows = X.faces_and_bodies(spark, d)[0].withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return rows.select("event_name", "image_id", "face_ord", r4("confidence").alias("confidence"))


@query("ag_contacts", sql("SELECT 'E' || (page_id % 4) AS event_name, 'Ann  Lee ' || (page_id % 5) AS person_name, split_part(min(path || chr(1) || '4' || page_id), chr(1), 2) AS phone_number FROM files WHERE path LIKE '%/reference/%' AND page_id % 7 IN (0, 1, 4) GROUP BY ALL"))
def _(spark, d):
    p = F.col("path")
    images = X.paths(spark, d).where(P.in_folder(p, "reference") & P.is_image(p, reference=True)).select(P.event_of(p).alias("event_name"), p.alias("image_path"))
    return matching.contacts(images)


def _labelled(spark, d) -> DataFrame:
    obs = X.observations(spark, d)
    cluster = F.when(F.col("true_person") < 22, F.floor((F.col("true_person") + F.col("observation_id") % 2) / 2))
    return obs.withColumn("cluster_id", cluster)


_LABELLED = "labelled AS (SELECT *, CASE WHEN true_person < 22 THEN (true_person + observation_id % 2) // 2 END AS cluster_id FROM obs), per AS (SELECT event_name, cluster_id, true_person, count(*) AS n FROM labelled WHERE cluster_id IS NOT NULL GROUP BY ALL), pure AS (SELECT event_name, cluster_id, sum(n)::BIGINT AS size, max(n) / sum(n) AS purity, count(*) > 1 AS is_mixed FROM per GROUP BY ALL)"


# Selection


def _members(spark, d) -> DataFrame:
    obs = X.observations(spark, d)
    return selection.members(obs, X.assignments(obs))


def _ranked(spark, d) -> DataFrame:
    rows = _members(spark, d)
    return rows.select("event_name", "cluster_id", "observation_id", F.col("face_pose").alias("pose"), Q.observation_quality(C).alias("quality"), Q.is_anchor(C).alias("anchor"))


_REPS = """ranked AS (SELECT p.event_name, a.cluster_id, p.observation_id, p.pose, p.quality, p.anchor FROM prepared p JOIN assign a USING (event_name, observation_id) WHERE a.cluster_id IS NOT NULL),
capped AS (SELECT *, row_number() OVER (PARTITION BY event_name, cluster_id, pose ORDER BY anchor DESC, quality DESC, observation_id) AS of_pose FROM ranked),
reps AS (SELECT *, row_number() OVER (PARTITION BY event_name, cluster_id ORDER BY anchor DESC, quality DESC, observation_id) AS rep_rank FROM capped WHERE pose IS NULL OR of_pose <= 3)"""


@query("wn_representatives", sql("SELECT event_name, cluster_id, observation_id, rep_rank::INTEGER AS rep_rank, anchor, round(quality, 4) AS quality FROM reps WHERE rep_rank <= 3", _REPS))
def _(spark, d):
    return selection.representatives(_ranked(spark, d), C).select("event_name", "cluster_id", "observation_id", "rep_rank", "anchor", r4("quality").alias("quality"))


_SINGLE = """single AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_name, cluster_id, image_id ORDER BY face_quality DESC, face_detection_confidence DESC, observation_id DESC) AS nth,
    min(observation_id) OVER (PARTITION BY event_name, cluster_id, image_id) AS first_id FROM member) WHERE nth = 1),
rated AS (SELECT *, 0.50::DOUBLE * face_quality + 0.25::DOUBLE * face_detection_confidence + 0.15::DOUBLE * person_detection_confidence + 0.10::DOUBLE * association_score AS best_score FROM single),
turns AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY event_name, cluster_id, face_pose ORDER BY best_score DESC, observation_id) = 1 AND face_pose IS NOT NULL THEN list_position(['frontal', 'left', 'right', 'profile'], face_pose) ELSE 99 END AS turn FROM rated),
picked AS (SELECT *, row_number() OVER (PARTITION BY event_name, cluster_id ORDER BY turn, best_score DESC, observation_id) AS pick FROM turns),
best AS (SELECT *, row_number() OVER (PARTITION BY event_name, cluster_id ORDER BY best_score DESC, observation_id) AS best_rank FROM picked WHERE pick <= 5)"""


@query("ag_one_per_image", sql("SELECT event_name, cluster_id, image_id, observation_id FROM single", _SINGLE))
def _(spark, d):
    return selection.one_per_image(_members(spark, d)).select("event_name", "cluster_id", "image_id", "observation_id")


@query("wn_best_images", sql("SELECT event_name, cluster_id, observation_id, best_rank::INTEGER AS best_rank, round(best_score, 4) AS best_score, face_pose FROM best", _SINGLE))
def _(spark, d):
    return selection.best_images(selection.one_per_image(_members(spark, d)), C).select("event_name", "cluster_id", "observation_id", "best_rank", r4("best_score").alias("best_score"), "face_pose")


@query("ag_person_representative", sql("SELECT event_name, person_name, observation_id, round(rep_score, 4) AS rep_score FROM (SELECT s.event_name, 'P' || (cluster_id // 2) AS person_name, observation_id, 0.7::DOUBLE * face_quality + 0.3::DOUBLE * face_detection_confidence AS rep_score, row_number() OVER (PARTITION BY s.event_name, cluster_id // 2 ORDER BY 0.7::DOUBLE * face_quality + 0.3::DOUBLE * face_detection_confidence DESC, cluster_id, first_id, observation_id) AS n FROM single s) WHERE n = 1", _SINGLE))
def _(spark, d):
    rows = _members(spark, d)
    first = rows.groupBy("event_name", "cluster_id", "image_id").agg(F.min("observation_id").alias("first_id"))
    single = selection.one_per_image(rows).join(first, ["event_name", "cluster_id", "image_id"]).withColumn("person_name", F.concat(F.lit("P"), F.floor(F.col("cluster_id") / 2).cast("string")))
    return selection.person_representative(single, C).select("event_name", "person_name", "observation_id", r4("rep_score").alias("rep_score"))


@query("ag_cluster_representative", sql("SELECT event_name, cluster_id, observation_id, round(rep_score, 4) AS rep_score FROM (SELECT *, 0.7::DOUBLE * face_quality + 0.3::DOUBLE * face_detection_confidence AS rep_score, row_number() OVER (PARTITION BY event_name, cluster_id ORDER BY 0.7::DOUBLE * face_quality + 0.3::DOUBLE * face_detection_confidence DESC, image_id, observation_id) AS n FROM member) WHERE n = 1"))
def _(spark, d):
    return selection.cluster_representative(_members(spark, d), C).select("event_name", "cluster_id", "observation_id", r4("rep_score").alias("rep_score"))


@query("wn_compact_ids", sql("SELECT event_name, observation_id, CASE WHEN true_person < 22 THEN dense_rank() OVER (PARTITION BY event_name, true_person < 22 ORDER BY first_id) - 1 END AS cluster_id FROM (SELECT *, min(observation_id) OVER (PARTITION BY event_name, true_person) AS first_id FROM obs)"))
def _(spark, d):
    obs = X.observations(spark, d)
    found = obs.where("true_person < 22").withColumn("first_id", F.min("observation_id").over(Window.partitionBy("event_name", "true_person")))
    return clustering.compact(obs, found.select("event_name", "observation_id", "first_id"))


@query("jn_conflicts", sql("SELECT DISTINCT a.event_name, a.cluster_id AS cluster_1, b.cluster_id AS cluster_2 FROM labelled a JOIN labelled b ON a.event_name = b.event_name AND a.image_id = b.image_id AND a.cluster_id < b.cluster_id", _LABELLED))
def _(spark, d):
    return clustering.conflicts(_labelled(spark, d))


@query("jn_unconflicted", sql("SELECT a.event_name, a.cluster_id AS cluster_1, b.cluster_id AS cluster_2 FROM sets a JOIN sets b ON a.event_name = b.event_name AND a.cluster_id < b.cluster_id WHERE NOT list_has_any(a.im, b.im)", _LABELLED, "sets AS (SELECT event_name, cluster_id, list(image_id) AS im FROM labelled WHERE cluster_id IS NOT NULL GROUP BY ALL)"))
def _(spark, d):
    sets = _labelled(spark, d).where("cluster_id is not null").groupBy("event_name", "cluster_id").agg(F.collect_set("image_id").alias("images"))
    a, b = sets.select("event_name", F.col("cluster_id").alias("cluster_1"), F.col("images").alias("x")), sets.select("event_name", F.col("cluster_id").alias("cluster_2"), F.col("images").alias("y"))
    return a.join(b, "event_name").where((F.col("cluster_1") < F.col("cluster_2")) & ~F.arrays_overlap("x", "y")).select("event_name", "cluster_1", "cluster_2")


@query("jn_missing_files", sql("SELECT event_name, count(DISTINCT image_id) AS missing FROM obs WHERE (observation_id % 75) % 4 = 0 GROUP BY 1"))
def _(spark, d):
    obs = X.observations(spark, d)
    there = obs.where((F.col("observation_id") % 75) % 4 != 0).select(F.col("image_id").alias("path")).distinct()
    return selection.missing_files(obs, there).groupBy("event_name").agg(F.count_distinct("image_id").alias("missing"))


@query("st_unanchored_clusters", sql("SELECT event_name, cluster_id FROM member EXCEPT SELECT p.event_name, a.cluster_id FROM prepared p JOIN assign a USING (event_name, observation_id) WHERE p.anchor AND a.cluster_id % 3 <> 0"))
def _(spark, d):
    rows = _members(spark, d)
    all_ = rows.select("event_name", "cluster_id").distinct()
    anchored = rows.where(Q.is_anchor(C) & (F.col("cluster_id") % 3 != 0)).select("event_name", "cluster_id").distinct()
    return all_.join(anchored, ["event_name", "cluster_id"], "left_anti")


@query("st_person_members", sql("SELECT event_name, cluster_id // 2 AS person, list_sort(list(observation_id)) AS members, count(DISTINCT image_id) AS images FROM member GROUP BY ALL"))
def _(spark, d):
    rows = _members(spark, d).groupBy("event_name", F.floor(F.col("cluster_id") / 2).alias("person"))
    return rows.agg(F.sort_array(F.collect_list("observation_id")).alias("members"), F.count_distinct("image_id").alias("images"))


# Clustering


@query("cl_agglomerate")
def _(spark, d):
    return clustering.cluster(X.observations(spark, d), C)


@query("cl_components", sql("SELECT event_name, observation_id, min(reach) AS component FROM walk GROUP BY ALL", _PAIRS, "edge AS (SELECT event_name, observation_id_a AS a, observation_id_b AS b FROM scores WHERE score >= 0.75 UNION SELECT event_name, observation_id_b, observation_id_a FROM scores WHERE score >= 0.75), walk(event_name, observation_id, reach) AS (SELECT DISTINCT event_name, a, a FROM edge UNION SELECT w.event_name, w.observation_id, e.b FROM walk w JOIN edge e ON e.event_name = w.event_name AND e.a = w.reach)").replace("WITH ", "WITH RECURSIVE ", 1))
def _(spark, d):
    rows = scoring.prepared(X.observations(spark, d), C)
    edges = scoring.pair_scores(rows, C, anchored=False).where(F.col("score") >= C.edge)
    return clustering.component_labels(edges.select("event_name", F.col("observation_id_a").alias("a"), F.col("observation_id_b").alias("b")))


@query("ag_cluster_sizes", sql("SELECT event_name, cluster_id, count(*) AS size FROM member GROUP BY ALL"))
def _(spark, d):
    return clustering.cluster_sizes(X.assignments(X.observations(spark, d)))


@query("ag_run_stats", sql("SELECT o.event_name, count(*) AS total_observations, count(*) AS valid_face_observations, count(cluster_id) AS clustered_observations, count(*) - count(cluster_id) AS unknown_observations, count(DISTINCT cluster_id) AS cluster_count FROM obs o JOIN assign a USING (event_name, observation_id) GROUP BY 1"))
def _(spark, d):
    obs = X.observations(spark, d)
    return clustering.run_stats(obs, X.assignments(obs))


_BARRED = """barred AS (SELECT a.event_name, count(*) AS n FROM prepared a JOIN prepared b ON a.event_name = b.event_name AND a.observation_id < b.observation_id WHERE a.image_id = b.image_id OR NOT (a.anchor OR b.anchor) GROUP BY 1)"""


@query("ag_rejections", sql("SELECT event_name, any_value(barred.n) AS rejected_same_image, count(*) FILTER (WHERE s.anchored AND s.score IS NULL) AS rejected_low_similarity FROM barred JOIN scores s USING (event_name) GROUP BY 1", _PAIRS, _BARRED))
def _(spark, d):
    return clustering.rejections(scoring.prepared(X.observations(spark, d), C), C)


# Jobs


@query("ag_job_counts", sql("SELECT e.event_name, s.status, count(j.job_id) AS n FROM (SELECT DISTINCT event_name FROM jobs) e CROSS JOIN (SELECT unnest(['PENDING', 'PROCESSING', 'COMPLETED', 'FAILED']) AS status) s LEFT JOIN jobs j ON j.event_name = e.event_name AND j.status = s.status GROUP BY ALL"))
def _(spark, d):
    return jobs.counts(X.image_jobs(spark, d))


@query("ag_next_ids", sql("SELECT event_name, coalesce(max(observation_id), -1) + 1 AS next_id FROM obs GROUP BY 1"))
def _(spark, d):
    return jobs.next_ids(X.observations(spark, d))


@query("ag_observation_counts", sql("SELECT event_name, count(*) AS n FROM obs GROUP BY 1"))
def _(spark, d):
    return X.observations(spark, d).groupBy("event_name").agg(F.count(F.lit(1)).alias("n"))


_JOB = "event_name, job_id, status, worker_id, attempts, error_message"


@query("qs_enqueue", sql("SELECT event_name, image_id, 'PENDING' AS status, (SELECT max(job_id) FROM jobs j WHERE j.event_name = x.event_name) + row_number() OVER (PARTITION BY event_name ORDER BY image_id) AS job_id FROM (SELECT DISTINCT event_name, image_id || CASE WHEN job_id % 3 = 0 THEN '.new' ELSE '' END AS image_id FROM jobs WHERE job_id % 3 = 0) x"))
def _(spark, d):
    all_ = X.image_jobs(spark, d)
    name = F.when(F.col("job_id") % 3 == 0, F.concat("image_id", F.lit(".new"))).otherwise(F.col("image_id"))
    images = all_.select("event_name", name.alias("image_id"), "image_path")
    return jobs.enqueue(all_, images.unionByName(images), NOW).select("event_name", "image_id", "status", "job_id")


@query("wn_next_job", sql("SELECT event_name, min(job_id) AS job_id FROM jobs WHERE status = 'PENDING' GROUP BY 1"))
def _(spark, d):
    return jobs.next_job(X.image_jobs(spark, d))


@query("qs_claim", sql("SELECT event_name, job_id, CASE WHEN mine THEN 'PROCESSING' ELSE status END AS status, CASE WHEN mine THEN 'w9' ELSE worker_id END AS worker_id, attempts + mine::INTEGER AS attempts, error_message FROM (SELECT *, status = 'PENDING' AND job_id % 20 < 10 AS mine FROM jobs)"))
def _(spark, d):
    all_ = X.image_jobs(spark, d)
    claims = all_.where("job_id % 20 < 10").select("event_name", "job_id", F.lit("w9").alias("worker"))
    return jobs.claim(all_, claims, NOW).select(*_JOB.split(", "))


@query("qs_finish", sql("SELECT event_name, job_id, CASE WHEN ours AND job_id % 4 = 0 THEN 'FAILED' WHEN ours THEN 'COMPLETED' ELSE status END AS status, worker_id, attempts, CASE WHEN ours AND job_id % 4 = 0 THEN 'broken' WHEN ours THEN NULL ELSE error_message END AS error_message FROM (SELECT *, status = 'PROCESSING' AND worker_id = 'w1' AS ours FROM jobs)"))
def _(spark, d):
    all_ = X.image_jobs(spark, d)
    outcomes = all_.select("event_name", "job_id", F.lit("w1").alias("worker"), F.when(F.col("job_id") % 4 == 0, "broken").alias("error"))
    return jobs.finish(all_, outcomes, NOW).select(*_JOB.split(", "))


@query("qs_refused", sql("SELECT event_name, job_id FROM jobs WHERE NOT (status = 'PROCESSING' AND worker_id = 'w1') OR worker_id IS NULL"))
def _(spark, d):
    all_ = X.image_jobs(spark, d)
    return jobs.refused(all_, all_.select("event_name", "job_id", F.lit("w1").alias("worker"))).select("event_name", "job_id")


@query("qs_recover_stale", sql("SELECT event_name, job_id, CASE WHEN stale THEN 'PENDING' ELSE status END AS status, CASE WHEN NOT stale THEN worker_id END AS worker_id, attempts, error_message FROM (SELECT *, coalesce(status = 'PROCESSING' AND started_at < (SELECT max(created_at) FROM jobs) - 86400, false) AS stale FROM jobs)"))
def _(spark, d):
    all_ = X.image_jobs(spark, d)
    now = all_.agg(F.max("created_at")).first()[0]
    return jobs.recover_stale(all_, now, replace(C, stale_seconds=86400.0)).select(*_JOB.split(", "))


@query("qs_retry_failed", sql("SELECT event_name, job_id, CASE WHEN again THEN 'PENDING' ELSE status END AS status, CASE WHEN NOT again THEN worker_id END AS worker_id, attempts, CASE WHEN NOT again THEN error_message END AS error_message FROM (SELECT *, status = 'FAILED' AND attempts = 1 AS again FROM jobs)"))
def _(spark, d):
    return jobs.retry_failed(X.image_jobs(spark, d)).select(*_JOB.split(", "))


@query("fn_progress", sql("SELECT event_name, round(100.0 * count(*) FILTER (WHERE status IN ('COMPLETED', 'FAILED')) / count(*), 1)::DOUBLE AS images_percent, round(round(100.0 * count(*) FILTER (WHERE status IN ('COMPLETED', 'FAILED')) / count(*), 1) * 0.7, 1)::DOUBLE AS overall_percent FROM jobs GROUP BY 1"))
def _(spark, d):
    return jobs.progress(jobs.counts(X.image_jobs(spark, d)))


@query("ag_event_failures", sql("SELECT count(*) FILTER (WHERE NOT bad) AS processed, count(*) FILTER (WHERE bad) AS failed, list_sort(list(event_name) FILTER (WHERE bad)) AS failed_events FROM (SELECT event_name, count(*) FILTER (WHERE status = 'PENDING') > (SELECT count(*) / 20 FROM jobs) AS bad FROM jobs GROUP BY 1)"))
def _(spark, d):
    counted = jobs.counts(X.image_jobs(spark, d)).where("status = 'PENDING'")
    most = X.table(spark, d, "events").count() / 20
    bad = F.col("n") > most
    return counted.agg(F.count_if(~bad).alias("processed"), F.count_if(bad).alias("failed"), F.sort_array(F.collect_list(F.when(bad, F.col("event_name")))).alias("failed_events"))


# State tables and sinks


@query("snk_upsert", sql("SELECT event_name, observation_id, round(CASE WHEN observation_id % 5 = 0 THEN 0.99 ELSE face_quality END, 4)::DOUBLE AS face_quality FROM obs UNION ALL SELECT event_name, observation_id + 100000, 0.99::DOUBLE FROM obs WHERE observation_id % 5 = 1"))
def _(spark, d):
    obs = X.observations(spark, d)
    again = obs.where("observation_id % 5 = 0").withColumn("face_quality", F.lit(0.99))
    fresh = obs.where("observation_id % 5 = 1").withColumn("face_quality", F.lit(0.99)).withColumn("observation_id", F.col("observation_id") + 100000)
    return state.upsert_observations(obs, again.unionByName(fresh)).select(*KEY, r4("face_quality").alias("face_quality"))


@query("snk_assign", sql("SELECT event_name, observation_id, CASE WHEN true_person < 22 THEN true_person END AS cluster_id FROM obs"))
def _(spark, d):
    obs = X.observations(spark, d)
    return state.assign(obs, X.assignments(obs)).select(*KEY, "cluster_id")


@query("snk_matches", sql("SELECT event_name, cluster_id, person_name, round(score, 6) AS similarity, round(margin, 6) AS margin, reference_image FROM matches WHERE accepted", _MATCH))
def _(spark, d):
    return matching.accepted(_matches(spark, d))


@query("src_matches", sql("SELECT event_name, cluster_id, person_name FROM matches WHERE accepted", _MATCH))
def _(spark, d):
    return matching.accepted(_matches(spark, d)).select("event_name", "cluster_id", "person_name").orderBy("event_name", "cluster_id")


_MANIFEST = """named AS (SELECT event_name, cluster_id, 'Person: ' || (cluster_id // 2) || '.' AS person_name FROM (SELECT DISTINCT event_name, cluster_id FROM member) WHERE cluster_id % 5 <> 4),
copied AS (
  SELECT event_name, cluster_id, 'All Images' AS kind, image_id, observation_id FROM single UNION ALL SELECT event_name, cluster_id, 'Best Images', image_id, observation_id FROM best),
placed AS (
  SELECT c.event_name, 'Person_ ' || (cluster_id // 2) AS person_folder, kind, image_id AS source, 'IMG_' || (observation_id % 75) AS stem, observation_id,
    row_number() OVER (PARTITION BY c.event_name, cluster_id // 2, kind, image_id ORDER BY observation_id) AS nth
  FROM copied c JOIN named USING (event_name, cluster_id)),
manifest AS (SELECT event_name, person_folder, kind, source, CASE WHEN nth > 1 THEN stem || '_' || observation_id || '.jpg' ELSE stem || '.jpg' END AS dest_name FROM placed)"""


def _manifest(spark, d) -> DataFrame:
    rows = _members(spark, d)
    named = rows.where("cluster_id % 5 <> 4").select("event_name", "cluster_id", F.concat(F.lit("Person: "), F.floor(F.col("cluster_id") / 2).cast("string"), F.lit(".")).alias("person_name")).distinct()
    return selection.person_manifest(rows, named, C)


@query("snk_person_manifest", sql("SELECT * FROM manifest", _SINGLE, _MANIFEST))
def _(spark, d):
    return _manifest(spark, d)


@query("ag_person_files", sql("SELECT event_name, person_folder, count(*) FILTER (WHERE kind = 'All Images') AS all_images, count(*) FILTER (WHERE kind = 'Best Images') AS best_images FROM manifest GROUP BY ALL", _SINGLE, _MANIFEST))
def _(spark, d):
    return _manifest(spark, d).groupBy("event_name", "person_folder").agg(F.count_if(F.col("kind") == "All Images").alias("all_images"), F.count_if(F.col("kind") == "Best Images").alias("best_images"))


@query("sv_folder_image", sql("SELECT event_name, person_folder, min_by(dest_name, CASE kind WHEN 'Best Images' THEN '2' ELSE '3' END || dest_name) AS image, true AS is_fallback FROM manifest GROUP BY ALL", _SINGLE, _MANIFEST))
def _(spark, d):
    return selection.folder_image(_manifest(spark, d))


@query("snk_cluster_manifest", sql("SELECT DISTINCT o.event_name, coalesce(format('cluster_{:03d}', a.cluster_id), 'noise') AS folder, o.image_id AS source, 'IMG_' || (o.observation_id % 75) || '.jpg' AS dest_name FROM obs o JOIN assign a USING (event_name, observation_id)"))
def _(spark, d):
    obs = X.observations(spark, d)
    return selection.cluster_manifest(state.assign(obs, X.assignments(obs)))


@query("snk_report", sql("SELECT p.event_name, 'Person ' || p.n AS name, CASE WHEN p.n < 20 THEN '2010000' || p.n ELSE '' END AS phone, CASE WHEN p.n % 2 = 0 THEN 'https://files/' || p.event_name || '/' || p.n ELSE '' END AS link FROM (SELECT DISTINCT event_name, true_person AS n FROM obs) p"))
def _(spark, d):
    people = X.observations(spark, d).select("event_name", "true_person").distinct()
    n = F.col("true_person").cast("string")
    folders = people.select("event_name", F.concat(F.lit("Person "), n).alias("person_folder"))
    urls = people.where("true_person % 2 = 0").select("event_name", F.concat(F.lit("Person "), n).alias("name"), F.concat(F.lit("https://files/"), "event_name", F.lit("/"), n).alias("link"))
    return selection.report(folders, matching.contacts(X.reference_faces(spark, d).select("event_name", "image_path")), urls)


_CROP = """crop AS (
  SELECT event_name, observation_id, greatest(0, fx1 - w // 4)::INTEGER AS x1, greatest(0, fy1 - w // 4)::INTEGER AS y1, least(480, fx2 + w // 4)::INTEGER AS x2, least(360, fy2 + w // 4)::INTEGER AS y2
  FROM (SELECT *, face_side AS w FROM obs))"""


@query("snk_crops", sql("SELECT event_name, observation_id, CASE WHEN x2 > x1 AND y2 > y1 THEN x1 END AS x1, CASE WHEN x2 > x1 AND y2 > y1 THEN y1 END AS y1, CASE WHEN x2 > x1 AND y2 > y1 THEN x2 END AS x2, CASE WHEN x2 > x1 AND y2 > y1 THEN y2 END AS y2 FROM crop", _CROP))
def _(spark, d):
    rows = selection.crops(X.observations(spark, d), 480, 360, C)
    return rows.select(*KEY, *[F.col(f"crop.{s}").alias(s) for s in G.FIELDS])


@query("snk_retry_schedule", "SELECT event_id, [least(power(2.0, n - 1), 10.0) for n in range(1, 2 + event_id % 6)] AS delays, (event_id % 7 IN (0, 3)) AS retriable FROM events")
def _(spark, d):
    i = F.col("event_id")
    status = F.when(i % 7 == 3, 503).when(i % 7 != 0, 404)
    delays = F.slice(jobs.retry_delays(6), F.lit(1), (1 + i % 6).cast("int"))
    return X.table(spark, d, "events").select("event_id", delays.alias("delays"), jobs.is_retriable(status).alias("retriable"))


@query("snk_migration", sql("SELECT event_name, job_id, image_id, CAST(NULL AS DOUBLE) AS face_yaw FROM jobs"))
def _(spark, d):
    old = X.image_jobs(spark, d).withColumn("image_id", F.concat(F.lit(" D:\\app\\"), F.replace("image_id", F.lit("/"), F.lit("\\"))))
    new = state.add_missing(old.withColumn("image_id", P.portable(F.col("image_id"))), {"face_yaw": "double", "image_id": "string"})
    return new.select("event_name", "job_id", "image_id", "face_yaw")


# Scalar functions


@query("fn_paths", sql("""SELECT page_id, substr(path, 6) AS canonical, path AS resolved, 'DATA/Events/W' || page_id || '/I.jpg' AS portable, 'Ann  Lee ' || (page_id % 5) AS person_name,
  '4' || page_id AS phone_number, regexp_extract(path, '[^/]+$') AS output_name, substr(sha1(path), 1, 8) AS short_hash FROM files"""))
def _(spark, d):
    p, i = F.col("path"), F.col("page_id")
    legacy = F.concat(F.lit("D:\\x\\DATA\\Events\\W"), i.cast("string"), F.lit("\\I.jpg"))
    return X.paths(spark, d).select(
        "page_id", P.canonical(p, "/srv").alias("canonical"), P.resolved(P.canonical(p, "/srv"), "/srv").alias("resolved"), P.portable(legacy).alias("portable"),
        P.person_name(p).alias("person_name"), P.phone_number(p).alias("phone_number"), P.output_name(p, i).alias("output_name"), P.short_hash(p).alias("short_hash"),
    )


@query("fn_names", """SELECT page_id, regexp_replace(regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g'), '\\.+$', '') AS person_folder, regexp_replace(url, '[^A-Za-z0-9 _.-]+', '_', 'g') AS event_folder, replace(url || '''', '''', '\\''') AS escaped FROM pages""")
def _(spark, d):
    u = F.col("url")
    return X.table(spark, d, "pages").select("page_id", P.person_folder(F.concat(F.lit(" "), u, F.lit(".. "))).alias("person_folder"), P.event_folder(u).alias("event_folder"), P.query_literal(F.concat(u, F.lit("'"))).alias("escaped"))


@query("fn_labels", "SELECT page_id, 'Face Pose Yaw ' || page_id AS label, 'out/E' || page_id AS output, page_id % 2 = 0 AS flag FROM pages")
def _(spark, d):
    i = F.col("page_id")
    return X.table(spark, d, "pages").select("page_id", P.label(F.concat(F.lit("FACE_POSE_YAW_"), i.cast("string"))).alias("label"), F.replace(P.event_output("/srv", F.concat(F.lit("E"), i.cast("string"))), F.lit("/srv/output/"), F.lit("out/")).alias("output"), F.when(i % 2 == 0, "true").otherwise("false").cast("boolean").alias("flag"))


@query("fn_urls", sql("SELECT page_id, replace(url_encode(path), '%2F', '/') AS url FROM files"))
def _(spark, d):
    return X.paths(spark, d).select("page_id", P.url(F.col("path")).alias("url"))


_SHARP = "(15.0 + (observation_id * 31) % 150)"


@query("fn_quality", sql(f"""SELECT event_name, observation_id, round(greatest(0.0, least(1.0, 0.4 * face_detection_confidence + 0.3 * greatest(0.0, least(1.0, (face_side - 40) / 80.0)) + 0.3 * greatest(0.0, least(1.0, ({_SHARP} - 20) / 130.0)))), 8)::DOUBLE AS face,
  round(CASE WHEN px1 IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 0.4 * person_detection_confidence + 0.3 * greatest(0.0, least(1.0, (least(px2 - px1, py2 - py1) - 100) / 300.0)) + 0.3 * greatest(0.0, least(1.0, ({_SHARP} - 20) / 130.0)))) END, 8)::DOUBLE AS body,
  round(0.7 * face_quality + 0.3 * face_detection_confidence, 8)::DOUBLE AS observation FROM obs"""))
def _(spark, d):
    sharp = F.lit(15.0) + (F.col("observation_id") * 31) % 150
    return X.observations(spark, d).select(
        *KEY, r8(Q.detection_quality(F.col("face_bbox"), F.col("face_detection_confidence"), sharp, C.face)).alias("face"),
        r8(Q.detection_quality(F.col("person_bbox"), F.col("person_detection_confidence"), sharp, C.body)).alias("body"), r8(Q.observation_quality(C)).alias("observation"),
    )


@query("fn_shares", "SELECT event_id, round(CASE WHEN event_id % 4 = 0 THEN greatest(0.0, least(1.0, value / 100)) ELSE 0.0 END, 4)::DOUBLE AS share, round(CASE WHEN value <= 20 THEN 0.0 WHEN value >= 150 THEN 1.0 ELSE (value - 20) / 130 END, 4)::DOUBLE AS scaled FROM events")
def _(spark, d):
    i, v = F.col("event_id"), F.col("value")
    x = F.when(i % 4 == 0, v / 100).when(i % 4 == 1, float("nan")).when(i % 4 == 2, float("-inf"))
    return X.table(spark, d, "events").select("event_id", r4(Q.share(x)).alias("share"), r4(Q.scaled(v, 20.0, 150.0)).alias("scaled"))


@query("fn_geometry", sql("SELECT event_name, image_id, face_ord::INTEGER AS face_ord, body_ord::INTEGER AS body_ord, farea::BIGINT AS face_area, barea::BIGINT AS body_area, inter::BIGINT AS overlap, (f1 + f3) / 2.0 BETWEEN b1 AND b3 AND (f2 + f4) / 2.0 BETWEEN b2 AND b4 AS inside, round(inter / (farea + barea - inter), 4) AS iou FROM fit", _FIT))
def _(spark, d):
    f, b = F.col("face"), F.col("body")
    rows = association.association_scores(*X.faces_and_bodies(spark, d))
    return rows.select("event_name", "image_id", "face_ord", "body_ord", G.area(f).alias("face_area"), G.area(b).alias("body_area"), G.overlap(f, b).alias("overlap"), G.contains(b, G.center(f)).alias("inside"), r4(G.iou(f, b)).alias("iou"))


@query("fn_crops", sql("""SELECT event_name, observation_id, CASE WHEN k THEN cx2 - cx1 END::INTEGER AS clamped_width, CASE WHEN k THEN cy2 - cy1 END::INTEGER AS clamped_height, CASE WHEN k THEN greatest(1, floor((cy2 - cy1) * 0.6::DOUBLE)) END::INTEGER AS upper_height
  FROM (SELECT *, coalesce(cx2 > cx1 AND cy2 > cy1, false) AS k FROM (SELECT *, greatest(0, px1) AS cx1, greatest(0, py1) AS cy1, least(480, px2) AS cx2, least(360, py2) AS cy2 FROM obs WHERE px1 IS NOT NULL))"""))
def _(spark, d):
    b, w, h = F.col("person_bbox"), F.lit(480), F.lit(360)
    c, u = G.clamp(b, w, h), G.upper_body(b, w, h, C.upper_body)
    return X.observations(spark, d).where("person_bbox is not null").select(*KEY, (c["x2"] - c["x1"]).alias("clamped_width"), (c["y2"] - c["y1"]).alias("clamped_height"), (u["y2"] - u["y1"]).alias("upper_height"))


@query("fn_pose", "SELECT event_id, round(((value + 90) % 180 + 180) % 180 - 90, 4) AS angle, CASE WHEN abs(a) <= 20 THEN 'frontal' WHEN abs(a) >= 55 THEN 'profile' WHEN a < 0 THEN 'left' ELSE 'right' END AS pose FROM (SELECT *, value - 60 AS a FROM events)")
def _(spark, d):
    v = F.col("value")
    return X.table(spark, d, "events").select("event_id", r4(Q.angle(v)).alias("angle"), Q.pose_of_yaw(v - 60, C).alias("pose"))


@query("fn_vectors", sql("SELECT a.i AS vec_id, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)), 4) AS cosine, CAST(NULL AS DOUBLE) AS uneven, round(sqrt(list_dot_product(a.v, a.v)), 4) AS norm FROM e a JOIN e b ON b.i = a.i + 1"))
def _(spark, d):
    e = X.table(spark, d, "embeddings").select("vec_id", "embedding")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    a, b = V.normalise(F.col("embedding")), V.normalise(F.col("other"))
    return both.select("vec_id", r4(V.cosine(a, b)).alias("cosine"), V.dot(a, F.slice("other", 1, 5)).alias("uneven"), r4(V.norm(F.col("embedding"))).alias("norm"))


# Evaluation


@query("ev_purity", sql("SELECT event_name, cluster_id, size, round(purity, 4)::DOUBLE AS purity, is_mixed FROM pure", _LABELLED))
def _(spark, d):
    return evaluate.cluster_purity(_labelled(spark, d)).withColumn("purity", r4("purity"))


@query("ev_false_merges", sql("SELECT event_name, round(avg(is_mixed::INTEGER), 4) AS false_merge_rate, round(avg(purity), 4) AS mean_purity FROM pure GROUP BY 1", _LABELLED))
def _(spark, d):
    return evaluate.false_merge_rate(evaluate.cluster_purity(_labelled(spark, d))).withColumn("false_merge_rate", r4("false_merge_rate")).withColumn("mean_purity", r4("mean_purity"))


@query("ev_fragmentation", sql("SELECT event_name, true_person, count(DISTINCT cluster_id) AS clusters FROM labelled WHERE cluster_id IS NOT NULL GROUP BY ALL", _LABELLED))
def _(spark, d):
    return evaluate.fragmentation(_labelled(spark, d))


@query("ev_unassigned", sql("SELECT event_name, round(avg((cluster_id IS NULL)::INTEGER), 4) AS unassigned_rate FROM labelled GROUP BY 1", _LABELLED))
def _(spark, d):
    return evaluate.unassigned_rate(_labelled(spark, d)).withColumn("unassigned_rate", r4("unassigned_rate"))


@query("ev_same_image", sql("SELECT event_name, cluster_id, image_id, count(*) AS n FROM labelled WHERE cluster_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1", _LABELLED))
def _(spark, d):
    return evaluate.same_image_violations(_labelled(spark, d))


@query("ev_pose_pairs", sql("SELECT least(coalesce(pose_a, 'unknown'), coalesce(pose_b, 'unknown')) AS pose_1, greatest(coalesce(pose_a, 'unknown'), coalesce(pose_b, 'unknown')) AS pose_2, count(*) AS n, round(avg(score), 4) AS mean_score FROM pairs GROUP BY ALL", _PAIRS))
def _(spark, d):
    obs = X.observations(spark, d)
    side = lambda s: obs.select("event_name", F.col("observation_id").alias(f"observation_id_{s}"), F.col("face_pose").alias(f"pose_{s}"))
    pairs = _pairs(spark, d).join(side("a"), ["event_name", "observation_id_a"]).join(side("b"), ["event_name", "observation_id_b"])
    return evaluate.pose_pairs(pairs).withColumn("mean_score", r4("mean_score"))


@query("ev_anchors", sql("SELECT event_name, count(*) FILTER (WHERE anchor) AS anchors, count(*) AS valid_faces, count(*) AS observations FROM prepared GROUP BY 1"))
def _(spark, d):
    return evaluate.anchor_counts(X.observations(spark, d), C)


@query("ev_outcomes", sql("SELECT event_name, CASE WHEN accepted THEN 'accepted' WHEN score < 0.55 THEN 'below_threshold' ELSE 'ambiguous' END AS outcome, count(*) AS n FROM matches GROUP BY ALL", _MATCH))
def _(spark, d):
    return evaluate.match_outcomes(_matches(spark, d), C)


@query("ev_availability", sql("SELECT event_name, 1.0::DOUBLE AS face_rate, round(avg((body_embedding IS NOT NULL)::INTEGER), 4) AS body_rate, round(avg((body_embedding IS NOT NULL)::INTEGER), 4) AS both_rate, 1.0::DOUBLE AS valid_face_rate, round(avg(body_embedding_valid::INTEGER), 4) AS valid_body_rate FROM obs GROUP BY 1"))
def _(spark, d):
    out = evaluate.availability(X.observations(spark, d))
    return out.select("event_name", *[r4(c).alias(c) for c in out.columns[1:]])


_IOU = "found AS (SELECT * FROM bodies WHERE confidence >= 0.4 AND class_id = 0), truth AS (SELECT image_id, body_ord AS truth_ord, x1, y1, x2, y2 FROM bodies WHERE body_ord % 2 = 0), met AS (SELECT f.image_id, f.body_ord, t.truth_ord FROM (SELECT *, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS a FROM found) f JOIN (SELECT *, greatest(0, x2 - x1) * greatest(0, y2 - y1) AS a FROM truth) t USING (image_id) WHERE greatest(0, least(f.x2, t.x2) - greatest(f.x1, t.x1)) * greatest(0, least(f.y2, t.y2) - greatest(f.y1, t.y1)) >= 0.5 * (f.a + t.a - greatest(0, least(f.x2, t.x2) - greatest(f.x1, t.x1)) * greatest(0, least(f.y2, t.y2) - greatest(f.y1, t.y1))))"


@query("ev_detection", sql("SELECT 'E0' AS event_name, round((SELECT count(*) FROM (SELECT DISTINCT image_id, body_ord FROM met)) / nullif((SELECT count(*) FROM found), 0), 4) AS precision, round((SELECT count(*) FROM (SELECT DISTINCT image_id, truth_ord FROM met)) / nullif((SELECT count(*) FROM truth), 0), 4) AS recall", _IOU))
def _(spark, d):
    bodies = X.faces_and_bodies(spark, d)[1]
    truth = bodies.where("body_ord % 2 = 0").withColumnRenamed("body_ord", "truth_ord")
    return evaluate.detection_scores(association.detections(bodies, C), truth).withColumn("precision", r4("precision")).withColumn("recall", r4("recall"))


@query("ev_poses", sql("SELECT event_name, coalesce(face_pose, 'unknown') AS pose, count(*) AS n, round(avg(face_detection_confidence), 4) AS mean_confidence, round(avg(face_side), 4) AS mean_size FROM obs GROUP BY ALL"))
def _(spark, d):
    return evaluate.pose_distribution(X.observations(spark, d)).withColumn("mean_confidence", r4("mean_confidence")).withColumn("mean_size", r4("mean_size"))


@query("ev_isolation", sql("SELECT event_name, cluster_id, 'elsewhere/' || reference_image AS reference_image FROM matches WHERE cluster_id % 5 = 0 AND reference_image IS NOT NULL", _MATCH))
def _(spark, d):
    """With references of another event planted: every fifth cluster."""
    planted = F.when(F.col("cluster_id") % 5 == 0, F.concat(F.lit("elsewhere/"), F.col("reference_image"))).otherwise(F.col("reference_image"))
    matches = _matches(spark, d).withColumn("reference_image", planted)
    return evaluate.isolation_violations(matches, _refs(spark, d)).select("event_name", "cluster_id", "reference_image")


# Totals


@query("ag_dashboard", sql("SELECT sum(images)::BIGINT AS images, sum(refs)::BIGINT AS refs, count(*) FILTER (WHERE images > 0) AS with_images FROM (SELECT page_id % 4 AS e, count(*) FILTER (WHERE path LIKE '%/Gallery/%' AND page_id % 7 IN (0, 1, 2, 4)) AS images, count(*) FILTER (WHERE path LIKE '%/reference/%' AND page_id % 7 IN (0, 1, 4)) AS refs FROM files GROUP BY 1)"))
def _(spark, d):
    p = F.col("path")
    rows = X.paths(spark, d).groupBy(P.event_of(p).alias("event_name")).agg(F.count_if(P.in_folder(p, "Gallery") & P.is_image(p)).alias("images"), F.count_if(P.in_folder(p, "reference") & P.is_image(p, True)).alias("refs"))
    return rows.agg(F.sum("images").alias("images"), F.sum("refs").alias("refs"), F.count_if(F.col("images") > 0).alias("with_images"))


@query("ag_distinct_images", sql("SELECT event_name, cluster_id, count(DISTINCT image_id) AS images FROM member GROUP BY ALL"))
def _(spark, d):
    return _members(spark, d).groupBy("event_name", "cluster_id").agg(F.count_distinct("image_id").alias("images"))


# Pixels, landmarks, models and streams: no SQL for these; the tests hold them


@query("fn_sharpness")
def _(spark, d):
    from ..functions.images import sharpness_of

    raw = F.encode("html", "utf-8")
    height = F.ceil(F.length(raw) / 16).cast("int")  # all bytes of a page, 16 in a row, the last row filled up
    rows = X.table(spark, d, "pages").where(F.length(raw) > 0).select("page_id", F.rpad(raw, height * 16, F.lit(b"\x00")).alias("pixels"), height.alias("height"))
    return rows.select("page_id", r4(sharpness_of("pixels", "height", F.lit(16))).alias("sharpness"))


@query("fn_head_pose")
def _(spark, d):
    from ..functions.images import head_pose_of

    i = F.col("event_id")
    points = ((40, 40), (60, 40), (50, 52), (42, 62), (58, 62))
    marks = F.array(*[F.array((F.lit(float(x)) + (i * (n + 3)) % 7).cast("double"), (F.lit(float(y)) + (i * (n + 5)) % 5).cast("double")) for n, (x, y) in enumerate(points)])
    rows = X.table(spark, d, "events").select("event_id", head_pose_of(marks).alias("p"))
    return rows.select("event_id", r4("p.yaw").alias("yaw"), r4("p.pitch").alias("pitch"), r4("p.roll").alias("roll"), Q.pose_of_yaw(F.col("p.yaw"), C).alias("pose"))


def _pixels(content: bytes):
    """Stands in for a decoder: a gray image of a page's bytes, 32 in a row, 32 rows or more; an empty page can't be read."""
    import numpy as np

    return np.frombuffer(content.ljust(max(1024, -(-len(content) // 32) * 32), b"\x00"), np.uint8).reshape(-1, 32) if content else None


def _persons(image) -> list[dict]:
    return [{"bbox": (int(image[0, n]) % 8, 2, 24 + int(image[1, n]) % 8, 30), "confidence": 0.3 + int(image[2, n]) % 7 / 10} for n in range(2)]


def _faces(image) -> list[dict]:
    marks = [[10, 10], [16, 10], [13, 14], [11, 18], [15, 18]]
    return [{"bbox": (8 + n, 6, 18 + n, 20), "confidence": 0.9, "landmarks": [[float(x + n), float(y)] for x, y in marks], "embedding": image[n, :8].astype(float)} for n in range(1 + int(image[3, 0]) % 2)]


def _encode(image, boxes) -> list:
    return [image[b[1], b[0] : b[0] + 6].astype(float) for b in boxes]


@query("ud_observations")
def _(spark, d):
    from . import observe

    images = X.paths(spark, d).join(X.table(spark, d, "pages").select("page_id", "html"), "page_id").select(P.event_of(F.col("path")).alias("event_name"), F.col("path").alias("image_id"), F.encode("html", "utf-8").alias("content"))
    obs = observe.observe(observe.detect(images, _pixels, _persons, _faces, _encode), C)
    return obs.select("event_name", "observation_id", "image_id", "observation_type", r4("association_score").alias("association_score"), r4("face_quality").alias("face_quality"), r4("body_quality").alias("body_quality"), "face_embedding_valid", "body_embedding_valid", "face_pose")


@query("qs_stream_states")
def _(spark, d):
    """Runs the stream of job changes to its end."""
    import uuid

    from ..sources.scratch import shared_dir
    from ..streaming.ingest import latest_states

    raw = spark.readStream.schema(X.table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    changes = raw.select(F.concat(F.lit("E"), (F.col("user_id") % 4).cast("string")).alias("event_name"), F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").cast("timestamp").alias("at"))
    name = f"states_{uuid.uuid4().hex}"
    mark = f"{shared_dir(spark).rstrip('/')}/{name}"
    states = latest_states(changes)
    states.writeStream.format("parquet").option("path", f"{mark}/rows").outputMode("append").option("checkpointLocation", f"{mark}/mark").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(states.schema).parquet(f"{mark}/rows")
