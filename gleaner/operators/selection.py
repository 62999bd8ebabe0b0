"""Representatives, best images, and the rows of output folders and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, POSES, Config
from ..functions import geometry as G
from ..functions import paths as P
from ..functions import quality as Q


def members(obs: DataFrame, assignments: DataFrame) -> DataFrame:
    return obs.drop("cluster_id").join(assignments.where("cluster_id is not null").select("event_name", "observation_id", "cluster_id"), ["event_name", "observation_id"])


def representatives(rows: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Up to N observations of a cluster that stand for it: anchors and quality first, a known pose at most per_pose times.

    rows: event_name, cluster_id, observation_id, pose, quality, anchor.  With N = 1 and an anchor, two are kept.
    """
    key = ["event_name", "cluster_id"]
    order = (F.desc("anchor"), F.desc("quality"), "observation_id")
    known = F.col("pose").isin(*POSES)
    rows = rows.withColumn("of_pose", F.row_number().over(Window.partitionBy(*key, Q.known_pose(F.col("pose"))).orderBy(*order)))
    rows = rows.where(~F.coalesce(known, F.lit(False)) | (F.col("of_pose") <= c.per_pose))
    rows = rows.withColumn("rep_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    most = F.when(F.lit(c.representatives == 1) & F.max("anchor").over(Window.partitionBy(*key)), 2).otherwise(c.representatives)
    return rows.withColumn("most", most).where("rep_rank <= most").drop("of_pose", "most")


def one_per_image(rows: DataFrame) -> DataFrame:
    """Best observation of a cluster in each image: by face quality, confidence, id."""
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    whole = F.struct(*rows.columns)
    best = rows.groupBy("event_name", "cluster_id", "image_id").agg(F.max_by(whole, F.struct(zero("face_quality"), zero("face_detection_confidence"), F.col("observation_id"))).alias("b"))
    return best.select("b.*")


def best_images(rows: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """K observations per cluster: the best of each known pose first, then by score."""
    key = ["event_name", "cluster_id"]
    rows = rows.withColumn("best_score", Q.best_image_score())
    order = (F.desc("best_score"), "observation_id")
    nth = F.row_number().over(Window.partitionBy(*key, "face_pose").orderBy(*order))
    turn = F.array_position(F.array(*[F.lit(p) for p in POSES]), F.col("face_pose"))
    rows = rows.withColumn("turn", F.when((nth == 1) & (turn > 0), turn).otherwise(99))
    rows = rows.withColumn("pick", F.row_number().over(Window.partitionBy(*key).orderBy("turn", *order))).where(F.col("pick") <= c.best)
    return rows.withColumn("best_rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).drop("turn", "pick")


def person_representative(rows: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """One face per person: by score, then cluster, then the first observation of its image.

    rows: one observation per cluster and image, with person_name and first_id (least observation of the image in the cluster).
    """
    rows = rows.where(Q.is_valid_face() & F.col("face_bbox").isNotNull()).withColumn("rep_score", Q.representative_score(c))
    order = Window.partitionBy("event_name", "person_name").orderBy(F.desc("rep_score"), "cluster_id", "first_id", "observation_id")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def cluster_representative(rows: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """One face per cluster: by score, then image, then observation."""
    rows = rows.where(Q.is_valid_face() & F.col("face_bbox").isNotNull()).withColumn("rep_score", Q.representative_score(c))
    order = Window.partitionBy("event_name", "cluster_id").orderBy(F.desc("rep_score"), "image_id", "observation_id")
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def person_manifest(rows: DataFrame, matches: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Files of each person's folder: all images and the best ones, with destination names made unique in their folder."""
    named = matches.select("event_name", "cluster_id", "person_name")
    single = one_per_image(rows)
    kinds = single.select("event_name", "cluster_id", "image_id", "observation_id", F.lit("All Images").alias("kind"), F.lit(0.0).alias("best_score"))
    best = best_images(single, c).select("event_name", "cluster_id", "image_id", "observation_id", F.lit("Best Images").alias("kind"), "best_score")
    files = kinds.unionByName(best).join(named, ["event_name", "cluster_id"])
    files = files.withColumn("person_folder", P.person_folder(F.col("person_name"))).withColumn("name", P.output_name(F.col("image_id"), F.col("observation_id")))
    files = files.dropDuplicates(["event_name", "person_folder", "kind", "image_id", "observation_id"])
    order = Window.partitionBy("event_name", "person_folder", "kind", "name").orderBy("image_id", "observation_id")
    files = files.withColumn("nth", F.row_number().over(order))
    late = F.concat(F.regexp_replace("name", r"\.[^.]+$", ""), F.lit("_"), F.col("observation_id").cast("string"), F.regexp_extract("name", r"(\.[^.]+)$", 1))
    return files.select("event_name", "person_folder", "kind", F.col("image_id").alias("source"), F.when(F.col("nth") > 1, late).otherwise(F.col("name")).alias("dest_name"))


def representative_crops(rows: DataFrame, matches: DataFrame, sizes: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """The picture of each person: event_name, person_folder, kind, source, crop rectangle, dest_name.

    sizes: event_name, image_id, width, height.  A face without room in its image gives none.
    """
    first = rows.groupBy("event_name", "cluster_id", "image_id").agg(F.min("observation_id").alias("first_id"))
    named = one_per_image(rows).join(matches.select("event_name", "cluster_id", "person_name"), ["event_name", "cluster_id"]).join(first, ["event_name", "cluster_id", "image_id"])
    best = person_representative(named, c).join(sizes, ["event_name", "image_id"])
    best = best.withColumn("crop", G.padded(F.col("face_bbox"), F.col("width"), F.col("height"), c.face_padding))
    return best.where("crop is not null").select("event_name", P.person_folder(F.col("person_name")).alias("person_folder"), F.lit("representative").alias("kind"), F.col("image_id").alias("source"), "crop", F.lit("representative Image.jpg").alias("dest_name"))


def cluster_crops(rows: DataFrame, sizes: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """The picture of each cluster, in a folder of representatives; columns as of representative_crops, but folder."""
    best = cluster_representative(rows.where("cluster_id is not null"), c).join(sizes, ["event_name", "image_id"])
    best = best.withColumn("crop", G.padded(F.col("face_bbox"), F.col("width"), F.col("height"), c.face_padding))
    return best.where("crop is not null").select("event_name", F.lit("representatives").alias("folder"), F.col("image_id").alias("source"), "crop", F.format_string("cluster_%03d.jpg", "cluster_id").alias("dest_name"))


def cluster_manifest(rows: DataFrame) -> DataFrame:
    """Files for looking at clusters: a folder per cluster and one for what belongs to none, each image once."""
    folder = F.when(F.col("cluster_id").isNull(), "noise").otherwise(F.format_string("cluster_%03d", "cluster_id"))
    files = rows.select("event_name", folder.alias("folder"), "image_id").distinct().withColumn("name", P.basename(F.col("image_id")))
    nth = F.row_number().over(Window.partitionBy("event_name", "folder", "name").orderBy("image_id"))
    late = F.concat(F.regexp_replace("name", r"\.[^.]+$", ""), F.lit("__"), P.short_hash(F.col("image_id")), F.regexp_extract("name", r"(\.[^.]+)$", 1))
    return files.withColumn("nth", nth).select("event_name", "folder", F.col("image_id").alias("source"), F.when(F.col("nth") > 1, late).otherwise(F.col("name")).alias("dest_name"))


def crops(rows: DataFrame, image_width: int, image_height: int, c: Config = DEFAULT) -> DataFrame:
    w, h = F.lit(image_width), F.lit(image_height)
    return rows.withColumn("crop", G.padded(F.col("face_bbox"), w, h, c.face_padding))


def report(folders: DataFrame, contact: DataFrame, urls: DataFrame) -> DataFrame:
    """Name, phone and link of each person folder, by name.  Phones are looked up by folder name."""
    people = folders.select("event_name", F.col("person_folder").alias("name")).distinct()
    phones = contact.select("event_name", F.col("person_name").alias("name"), F.col("phone_number").alias("phone"))
    rows = people.join(phones, ["event_name", "name"], "left").join(urls.select("event_name", "name", "link"), ["event_name", "name"], "left")
    return rows.select("event_name", "name", F.coalesce("phone", F.lit("")).alias("phone"), F.coalesce("link", F.lit("")).alias("link")).orderBy("event_name", F.lower("name"), "name")


def missing_files(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose image isn't there."""
    return rows.join(files.select(F.col("path").alias("image_id")), "image_id", "left_anti")


def folder_image(rows: DataFrame) -> DataFrame:
    """The picture that stands for a person: its representative, else the first best, else the first image.

    rows: event_name, person_folder, kind ('representative', 'Best Images', 'All Images'), dest_name.
    """
    turn = F.when(F.col("kind") == "representative", 1).when(F.col("kind") == "Best Images", 2).otherwise(3)
    first = rows.groupBy("event_name", "person_folder").agg(F.min(F.struct(turn.alias("turn"), "dest_name")).alias("x"))
    return first.select("event_name", "person_folder", F.col("x.dest_name").alias("image"), (F.col("x.turn") > 1).alias("is_fallback"))
