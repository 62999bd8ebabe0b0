"""Quality, validity, pose and pair-score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, POSES, Config, Quality
from . import geometry as G
from . import vector as V


def scaled(x: Column, low: float, high: float) -> Column:
    """Piecewise linear from 0 at low to 1 at high."""
    if high <= low:
        raise ValueError("high must exceed low")
    return F.when(x <= low, 0.0).when(x >= high, 1.0).otherwise((x - F.lit(low)) / F.lit(high - low))


def share(x: Column) -> Column:
    """x held to [0, 1]; null, NaN and infinite count as 0."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(V.clip(x, 0.0, 1.0))


def size_quality(b: Column, q: Quality) -> Column:
    return F.when(b.isNull(), 0.0).otherwise(scaled(G.short_side(b).cast("double"), *q.size_range))


def detection_quality(b: Column, confidence: Column, sharpness: Column, q: Quality) -> Column:
    """Weighted confidence, size and sharpness of a detection; 0 without box or confidence."""
    total = q.detection * confidence + q.size * size_quality(b, q) + q.sharpness * scaled(F.coalesce(sharpness, F.lit(0.0)), *q.sharpness_range)
    return F.when(b.isNull() | confidence.isNull(), 0.0).otherwise(V.clip(total, 0.0, 1.0))


def observation_quality(c: Config = DEFAULT) -> Column:
    return c.quality_face * share(F.col("face_quality")) + c.quality_detection * share(F.col("face_detection_confidence"))


def best_image_score() -> Column:
    # The weights of the best-image score.
    weights = {"face_quality": 0.50, "face_detection_confidence": 0.25, "person_detection_confidence": 0.15, "association_score": 0.10}
    total = None
    for name, w in weights.items():
        term = w * share(F.col(name))
        total = term if total is None else total + term
    return total


def representative_score(c: Config = DEFAULT) -> Column:
    """Quality and confidence as they stand: null counts as 0, nothing is held to [0, 1]."""
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    return c.quality_face * zero("face_quality") + c.quality_detection * zero("face_detection_confidence")


def observation_type(face: str = "face_embedding", body: str = "body_embedding") -> Column:
    """By which embeddings are present, valid or not."""
    f, b = F.col(face).isNotNull(), F.col(body).isNotNull()
    return F.when(f & b, "face_and_body").when(f, "face_only").when(b, "body_only").otherwise("empty")


def is_valid_face() -> Column:
    return F.coalesce(F.col("face_embedding_valid"), F.lit(False)) & V.is_valid(F.col("face_embedding"))


def is_anchor(c: Config = DEFAULT) -> Column:
    """Trusted frontal observation: good enough in quality, confidence and size, and near enough to the front."""
    zero = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    b = F.col("face_bbox")
    ok = (
        is_valid_face() & b.isNotNull() & (F.col("face_pose") == "frontal") & (zero("face_quality") >= c.anchor_quality)
        & (zero("face_detection_confidence") >= c.anchor_confidence) & (G.short_side(b) >= c.anchor_size)
        & (F.col("face_yaw").isNull() | (F.abs("face_yaw") <= c.anchor_yaw))
    )
    return F.coalesce(ok, F.lit(False))


def known_pose(p: Column) -> Column:
    return F.when(p.isin(*POSES), p).otherwise("unknown")


def is_cross_pose(a: Column, b: Column) -> Column:
    """Both poses known, and different."""
    return F.coalesce(a.isin(*POSES) & b.isin(*POSES) & (a != b), F.lit(False))


def angle(a: Column) -> Column:
    """An angle as one in [-90, 90)."""
    return F.pmod(a + 90.0, F.lit(180.0)) - 90.0


def pose_of_yaw(yaw: Column, c: Config = DEFAULT) -> Column:
    a = F.abs(yaw)
    return F.when(yaw.isNull(), None).when(a <= c.frontal_yaw, "frontal").when(a >= c.profile_yaw, "profile").when(yaw < 0, "left").otherwise("right")


def pair_score(face: Column, body: Column, cross: Column, quality_a: Column, quality_b: Column, c: Config = DEFAULT) -> Column:
    """Score of two observations from their similarities (body null where unknown), or null where a gate closes."""
    quality = (quality_a + quality_b) / F.lit(2.0)
    with_body = c.face_weight * face + c.body_weight * V.clip((body + 1.0) / 2.0, 0.0, 1.0) + c.quality_weight * quality
    alone = c.face_only_weight * face + c.face_only_quality_weight * quality
    score = V.clip(F.when(body.isNotNull(), with_body).otherwise(alone), 0.0, 1.0)
    weak_body = F.coalesce((face < c.min_face) & (body < c.cross_body), F.lit(False))
    gated = F.when(face.isNull(), None).when(cross & ((face < c.cross_face) | weak_body), None).when(~cross & (face < c.min_face), None)
    return gated.when(cross & (score < c.cross_merge), None).otherwise(score)
