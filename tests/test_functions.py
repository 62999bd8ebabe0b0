"""Column functions at their edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.config import Config, Quality
from gleaner.functions import geometry as G
from gleaner.functions import images as I
from gleaner.functions import paths as P
from gleaner.functions import quality as Q
from gleaner.functions import vector as V
from gleaner.operators import jobs


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_embedding_validity(spark):
    rows = [(1, None), (2, []), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [3.0, 4.0]), (8, [1e300, 1e300])]
    got = dict(values(spark, rows, "i int, v array<double>", "i", V.is_valid(F.col("v"))))
    assert got == {1: False, 2: False, 3: False, 4: False, 5: False, 6: False, 7: True, 8: False}
    assert values(spark, rows[6:7], "i int, v array<double>", V.normalise(F.col("v"))) == [([0.6, 0.8],)]
    assert values(spark, rows[4:5], "i int, v array<double>", V.normalise(F.col("v")), V.normalise_or_keep(F.col("v"))) == [(None, [0.0, 0.0])]


def test_dot_of_uneven_vectors_is_null(spark):
    rows = [([1.0, 2.0], [3.0]), ([1.0, 2.0], [3.0, 4.0]), (None, [1.0])]
    assert values(spark, rows, "a array<double>, b array<double>", V.dot(F.col("a"), F.col("b"))) == [(None,), (11.0,), (None,)]


def test_cross_pose_needs_two_known_poses(spark):
    rows = [("frontal", "left"), ("left", "left"), (None, "left"), ("unknown", "left"), (None, None)]
    assert [r[0] for r in values(spark, rows, "a string, b string", Q.is_cross_pose(F.col("a"), F.col("b")))] == [True, False, False, False, False]


@pytest.mark.parametrize("face,body,cross,want", [
    (0.59, None, True, None), (0.56, None, False, 0.75 * 0.56 + 0.25 * 0.5), (0.54, 0.9, False, None), (0.9, 0.9, True, 0.65 * 0.9 + 0.2 * 0.95 + 0.15 * 0.5), (0.7, -1.0, True, None), (None, 0.5, False, None), (1.0, 1.0, False, 1.0 * 0.85 + 0.075),
])
def test_pair_score(spark, face, body, cross, want):
    got = values(spark, [(face, body, cross, 0.4, 0.6)], "f double, b double, x boolean, p double, q double", Q.pair_score(*[F.col(c) for c in "fbxpq"]))[0][0]
    assert got == (None if want is None else pytest.approx(want))


def test_body_gate_counts_when_thresholds_allow(spark):
    loose = Config(cross_face=0.4, cross_merge=0.1)
    rows = [(0.5, 0.4, True, 1.0, 1.0), (0.5, 0.6, True, 1.0, 1.0)]
    got = values(spark, rows, "f double, b double, x boolean, p double, q double", Q.pair_score(*[F.col(c) for c in "fbxpq"], loose))
    assert got[0][0] is None and got[1][0] is not None


def test_shares_and_ranges(spark):
    rows = [(None,), (float("nan"),), (float("inf"),), (-1.0,), (0.25,), (7.0,)]
    assert [r[0] for r in values(spark, rows, "x double", Q.share(F.col("x")))] == [0, 0, 0, 0, 0.25, 1]
    assert [r[0] for r in values(spark, [(40.0,), (80.0,), (120.0,), (500.0,)], "x double", Q.scaled(F.col("x"), 40.0, 120.0))] == [0, 0.5, 1, 1]
    with pytest.raises(ValueError):
        Q.scaled(F.lit(1.0), 2.0, 2.0)


def test_association_score(spark):
    b = lambda *s: dict(zip(G.FIELDS, s, strict=True))
    rows = [(b(0, 0, 10, 10), b(0, 0, 100, 100)), (b(0, 0, 10, 10), b(8, 0, 100, 100)), (b(0, 0, 10, 10), b(5, 5, 5, 9)), (b(3, 3, 3, 3), b(0, 0, 9, 9)), (b(0, 0, 10, 10), b(5, 0, 9, 10))]
    got = values(spark, rows, "f struct<x1:int,y1:int,x2:int,y2:int>, b struct<x1:int,y1:int,x2:int,y2:int>", G.association(F.col("f"), F.col("b")))
    assert [r[0] for r in got] == pytest.approx([1.0, 0.2, 0.0, 0.5, 0.7])


def test_crops(spark):
    box = "b struct<x1:int,y1:int,x2:int,y2:int>"
    rows = [(dict(x1=-5, y1=10, x2=35, y2=50),), (dict(x1=10, y1=10, x2=10, y2=20),), (dict(x1=95, y1=95, x2=130, y2=130),)]
    w = F.lit(100)
    got = values(spark, rows, box, G.padded(F.col("b"), w, w, 0.25), G.padded_inside(F.col("b"), w, w, 0.25), G.upper_body(F.col("b"), w, w, 0.6))
    assert [tuple(x) if x else None for x in got[0]] == [(0, 0, 45, 60), (0, 0, 43, 60), (0, 10, 35, 34)]
    assert got[1] == (None, None, None)
    assert [tuple(x) for x in got[2]] == [(87, 87, 100, 100), (94, 94, 100, 100), (95, 95, 100, 98)]


def test_names_and_paths(spark):
    rows = [("r/A - B - 1.jpg",), ("r/NoPhone.png",), ("r/ - 5.jpg",), ("r/Zoë: X - 9.JPG",)]
    p = F.col("p")
    got = values(spark, rows, "p string", P.person_name(p), P.phone_number(p), P.person_folder(P.person_name(p)), P.extension(p))
    assert got == [("A", "B - 1", "A", ".jpg"), ("NoPhone", "", "NoPhone", ".png"), ("- 5", "", "- 5", ".jpg"), ("Zoë: X", "9", "Zoë_ X", ".jpg")]
    assert values(spark, [("  .. ",), (None,), ('a<b>"c',), ("x  y..",)], "p string", P.person_folder(p)) == [("Unknown Person",), ("Unknown Person",), ("a_b__c",), ("x y",)]
    legacy = [("D:\\x\\DATA\\Events\\W\\I.jpg",), ("/srv/data/events/E/i.jpg",), ("plain.jpg",)]
    assert values(spark, legacy, "p string", P.portable(p)) == [("DATA/Events/W/I.jpg",), ("data/events/E/i.jpg",), ("plain.jpg",)]
    assert values(spark, [("/srv/data/events/E/i.jpg",), ("data/events/E/i.jpg",), ("E/i.jpg",)], "p string", P.canonical(p, "/srv")) == [("data/events/E/i.jpg",)] * 3
    with pytest.raises(Exception, match="not under the events root"):
        values(spark, [("/other/i.jpg",)], "p string", P.canonical(p, "/srv"))
    assert values(spark, [("a b/ü+c.jpg",)], "p string", P.url(p)) == [("a%20b/%C3%BC%2Bc.jpg",)]


def test_angles_and_poses(spark):
    rows = [(-90.0,), (90.0,), (179.0,), (-20.0,), (20.5,), (-54.0,), (55.0,), (None,)]
    got = values(spark, rows, "a double", Q.angle(F.col("a")), Q.pose_of_yaw(F.col("a")))
    assert [g[0] for g in got] == [-90, -90, -1, -20, 20.5, -54, 55, None]
    assert [g[1] for g in got] == ["profile", "profile", "profile", "frontal", "right", "left", "profile", None]


def test_sharpness():
    flat, check = np.full((8, 8), 90, np.uint8), (np.indices((8, 8)).sum(0) % 2 * 255).astype(np.uint8)
    assert I.sharpness(flat) == 0 and I.sharpness(np.empty((0, 4))) == 0 and I.sharpness(check) == pytest.approx(1020.0**2)
    assert I.sharpness(np.stack([check] * 3, -1)) == pytest.approx(1020.0**2)


@pytest.mark.parametrize("yaw,pitch,roll", [(0, 0, 0), (30, 0, 0), (-25, 10, 5), (15, -12, -20)])
def test_head_pose_of_projected_model(yaw, pitch, roll):
    a, b, c = (math.radians(x) for x in (pitch + 180, yaw, roll))
    rx = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]])
    ry = np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
    rz = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
    p = I.FACE_MODEL @ (rz @ ry @ rx).T + np.array([5.0, -3.0, 900.0])
    pts = p[:, :2] / p[:, 2:] * 1000 + np.array([500, 400])
    got = I.head_pose(pts, (800, 1000))
    assert got == pytest.approx((pitch, yaw, roll), abs=0.05)


def test_head_pose_refuses_bad_landmarks():
    assert I.head_pose(None) is None and I.head_pose([[1, 2]] * 4) is None and I.head_pose([[float("nan"), 1]] * 5) is None
    assert I.camera(np.array([[0, 0], [40, 10], [20, 30], [5, 5], [6, 6]]))[0] == 160 and I.camera(np.zeros((5, 2)))[0] == 4


def test_config_is_checked():
    for bad in ({"merge": 1.2}, {"face_weight": 0.9}, {"min_cluster": 0}, {"frontal_yaw": 60.0}, {"quality_face": 0.6}, {"match": float("nan")}, {"face": Quality(size_range=(5.0, 5.0))}):
        with pytest.raises(ValueError):
            Config(**bad)
    assert Config(merge=0.7).edge == 0.7


def test_retries_and_phases(spark):
    assert values(spark, [(1,)], "x int", jobs.retry_delays(6)) == [([1.0, 2.0, 4.0, 8.0, 10.0, 10.0],)]
    rows = [("",), ("Constrained Identity Clustering ... [output]",), ("PROCESSING COMPLETE",), ("PROCESSING COMPLETE" + " " * 13000,)]
    assert [r[0] for r in values(spark, rows, "t string", jobs.phase_of(F.col("t")))] == ["image_processing", "output", "complete", "image_processing"]
