"""Boxes as struct<x1,y1,x2,y2>: sizes, overlap, crops."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELDS = ("x1", "y1", "x2", "y2")


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """A box, or null where any side is."""
    sides = dict(zip(FIELDS, (x1, y1, x2, y2), strict=True))
    known = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    return F.when(known, F.struct(*[c.cast("int").alias(n) for n, c in sides.items()]))


def sides(b: Column, prefix: str) -> list[Column]:
    return [b[f].alias(f"{prefix}_{f}") for f in FIELDS]


def width(b: Column) -> Column:
    return F.greatest(F.lit(0), b["x2"] - b["x1"])


def height(b: Column) -> Column:
    return F.greatest(F.lit(0), b["y2"] - b["y1"])


def area(b: Column) -> Column:
    return width(b).cast("long") * height(b).cast("long")


def short_side(b: Column) -> Column:
    return F.least(width(b), height(b))


def center(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / F.lit(2.0)).alias("x"), ((b["y1"] + b["y2"]) / F.lit(2.0)).alias("y"))


def contains(b: Column, point: Column) -> Column:
    """Inclusive on all sides."""
    return point["x"].between(b["x1"], b["x2"]) & point["y"].between(b["y1"], b["y2"])


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(F.lit(0), w).cast("long") * F.greatest(F.lit(0), h).cast("long")


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - overlap(a, b)
    return F.when(union > 0, overlap(a, b) / union).otherwise(F.lit(0.0))


def association(face: Column, body: Column) -> Column:
    """How well a face fits a body: the share of the face inside, lifted to [0.5, 1] where the face's centre is inside."""
    share = F.when(area(face) > 0, overlap(face, body) / area(face)).otherwise(F.lit(0.0))
    return F.when(area(body) <= 0, F.lit(0.0)).when(contains(body, center(face)), 0.5 + 0.5 * share).otherwise(share)


def clamp(b: Column, image_width: Column, image_height: Column) -> Column:
    """The part of a box inside the image, or null where nothing is left."""
    x1, y1 = F.greatest(F.lit(0), b["x1"]), F.greatest(F.lit(0), b["y1"])
    x2, y2 = F.least(image_width, b["x2"]), F.least(image_height, b["y2"])
    return F.when((x2 > x1) & (y2 > y1), box(x1, y1, x2, y2))


def upper_body(b: Column, image_width: Column, image_height: Column, share: float) -> Column:
    """The upper share of the clamped box, one pixel at least."""
    c = clamp(b, image_width, image_height)
    tall = F.greatest(F.lit(1), F.floor((c["y2"] - c["y1"]) * F.lit(share)).cast("int"))
    return F.when(c.isNotNull(), box(c["x1"], c["y1"], c["x2"], c["y1"] + tall))


def padded(b: Column, image_width: Column, image_height: Column, share: float) -> Column:
    """The box with that share of its sides added around, inside the image; null for a box without extent."""
    w, h = b["x2"] - b["x1"], b["y2"] - b["y1"]
    dx, dy = F.floor(w * F.lit(share)).cast("int"), F.floor(h * F.lit(share)).cast("int")
    x1, y1 = F.greatest(F.lit(0), b["x1"] - dx), F.greatest(F.lit(0), b["y1"] - dy)
    x2, y2 = F.least(image_width, b["x2"] + dx), F.least(image_height, b["y2"] + dy)
    return F.when((w > 0) & (h > 0) & (x2 > x1) & (y2 > y1), box(x1, y1, x2, y2))


def padded_inside(b: Column, image_width: Column, image_height: Column, share: float) -> Column:
    """As padded(), but the box is moved inside the image before its padding is measured."""
    x1 = F.greatest(F.lit(0), F.least(b["x1"], image_width - 1))
    y1 = F.greatest(F.lit(0), F.least(b["y1"], image_height - 1))
    x2 = F.greatest(F.lit(0), F.least(b["x2"], image_width))
    y2 = F.greatest(F.lit(0), F.least(b["y2"], image_height))
    return padded(F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")), image_width, image_height, share)
