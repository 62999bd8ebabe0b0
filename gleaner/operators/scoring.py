"""Observation pairs and their scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import quality as Q
from ..functions import vector as V


def prepared(obs: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """The valid faces, with all that pair scores need: unit vectors, quality, anchor.

    Worked out once per observation, before any pair is formed.
    """
    body = F.when(F.coalesce(F.col("body_embedding_valid"), F.lit(False)), V.normalise(F.col("body_embedding")))
    return obs.where(Q.is_valid_face()).select(
        "event_name", "observation_id", "image_id", F.col("face_pose").alias("pose"),
        V.normalise(F.col("face_embedding")).alias("face"), body.alias("body"),
        Q.observation_quality(c).alias("quality"), Q.is_anchor(c).alias("anchor"),
    )


#: Observations of a block; the pairs of an event are dealt over tasks by the blocks of both sides.
BLOCK = 1024


def dealt(rows: DataFrame, by: str = "observation_id") -> DataFrame:
    """rows with `block`, of about BLOCK rows of their event each, and how many `blocks` the event has."""
    many = rows.groupBy("event_name").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    return rows.join(many, "event_name").withColumn("block", F.pmod(F.xxhash64(F.lit(17), by), F.col("blocks")).cast("int"))


def every_pair(rows: DataFrame, on: Callable[[], Column] | None = None) -> DataFrame:
    """Sides _a and _b of all pairs of an event with a before b (and on); each pair of blocks is a key of its own."""
    rows = dealt(rows)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = _side(rows.withColumn("y", other).withColumnRenamed("block", "x").drop("blocks"), "a")
    b = _side(rows.withColumn("x", other).withColumnRenamed("block", "y").drop("blocks"), "b").withColumnRenamed("event_name", "event_b")
    cond = (F.col("event_name") == F.col("event_b")) & (F.col("x_a") == F.col("x_b")) & (F.col("y_a") == F.col("y_b")) & (F.col("observation_id_a") < F.col("observation_id_b"))
    return a.join(b, cond & on() if on else cond).drop("event_b", "x_a", "x_b", "y_a", "y_b")


def _side(rows: DataFrame, s: str) -> DataFrame:
    return rows.select("event_name", *[F.col(n).alias(f"{n}_{s}") for n in rows.columns if n != "event_name"])


def scored(pairs: DataFrame, c: Config = DEFAULT, keep_all: bool = False) -> DataFrame:
    """Joined sides _a and _b, without their vectors, with face_similarity, body_similarity, cross_pose and score.

    Pairs without a score go, unless all are kept.  Similarities are bound once, and the filter is part of the generator:
    as a predicate over a projection it would be pushed down and work out every inner product again.
    """
    sims = F.struct(
        V.cosine(F.col("face_a"), F.col("face_b")).alias("face"), V.cosine(F.col("body_a"), F.col("body_b")).alias("body"),
        Q.is_cross_pose(F.col("pose_a"), F.col("pose_b")).alias("cross"),
    )
    whole = lambda s: F.struct(
        s["face"].alias("face_similarity"), s["body"].alias("body_similarity"), s["cross"].alias("cross_pose"),
        Q.pair_score(s["face"], s["body"], s["cross"], F.col("quality_a"), F.col("quality_b"), c).alias("score"),
    )
    rows = F.transform(F.array(sims), whole)
    if not keep_all:
        rows = F.filter(rows, lambda x: x["score"].isNotNull())
    vectors = ("face_a", "face_b", "body_a", "body_b")
    return pairs.select(*[n for n in pairs.columns if n not in vectors], F.inline(rows))


def pair_scores(rows: DataFrame, c: Config = DEFAULT, anchored: bool = True) -> DataFrame:
    """All scored pairs of an event: a before b, other images, one side anchored (unless told otherwise)."""

    def on() -> Column:
        apart = F.col("image_id_a") != F.col("image_id_b")
        return apart & (F.col("anchor_a") | F.col("anchor_b")) if anchored else apart

    pairs = scored(every_pair(rows, on), c)
    return pairs.select("event_name", "observation_id_a", "observation_id_b", "face_similarity", "body_similarity", "cross_pose", "score")


def cluster_pair_scores(scores: DataFrame, members: DataFrame) -> DataFrame:
    """Best score of two clusters over their representatives; scores holds pairs of observations, members their clusters."""
    side = lambda s: members.select("event_name", F.col("observation_id").alias(f"observation_id_{s}"), F.col("cluster_id").alias(f"cluster_{s}"))
    both = scores.join(side("a"), ["event_name", "observation_id_a"]).join(side("b"), ["event_name", "observation_id_b"]).where("cluster_a <> cluster_b")
    return both.groupBy("event_name", F.least("cluster_a", "cluster_b").alias("cluster_1"), F.greatest("cluster_a", "cluster_b").alias("cluster_2")).agg(F.max("score").alias("score"))
