"""Sources, sinks, the per-image part and streaming, over small trees of files."""

import sqlite3
import zipfile
from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import jobs, selection, state
from gleaner.plans import engine, fixtures, observe
from gleaner.sources import blobs, files, manifest, settings, sqlite, xlsx
from gleaner.streaming import ingest

FACE = np.array([[40, 40], [60, 40], [50, 52], [42, 62], [58, 62]], float)


def image(seed, faces=1):
    """A tiny 'file': height, width, number of faces, then noise."""
    return bytes([80, 100, faces]) + np.random.default_rng(seed).bytes(80 * 100)


def decode(content):
    if content[:3] == b"bad":
        return None
    img = np.frombuffer(content, np.uint8)[3:].reshape(content[0], content[1]).copy()
    img[0, 0] = content[2]
    return img


def persons(img):
    return [{"bbox": (20, 10, 90, 80), "confidence": 0.8}, {"bbox": (0, 0, 5, 5), "confidence": 0.1}]


def faces(img):
    return [{"bbox": (30 + 5 * n, 30, 75 + 5 * n, 75), "confidence": 0.9 - 0.1 * n, "landmarks": (FACE + 5 * n).tolist(), "embedding": np.eye(4)[n]} for n in range(int(img[0, 0]))]


def encode(img, boxes):
    return [np.ones(3) if b[2] - b[0] > 10 else None for b in boxes]


@pytest.fixture
def tree(tmp_path):
    for event, names in {"b Event": ["x 1.jpg", "y+2.PNG", "skip.txt"], "A": ["z.avif"]}.items():
        d = tmp_path / "data/events" / event
        (d / "Gallery/sub").mkdir(parents=True)
        (d / "reference").mkdir()
        for n, name in enumerate(names):
            (d / "Gallery/sub" / name).write_bytes(image(n, 1 + n))
        (d / "reference" / "Ann - 123.jpg").write_bytes(image(9))
        (d / "reference" / "Bob.avif").write_bytes(image(9))
    (tmp_path / "data/events/A/Gallery/broken.jpg").write_bytes(b"bad")
    return tmp_path


def test_discovery_and_scans(spark, tree):
    assert files.events(spark, str(tree)) == ["A", "b Event"]
    got = {(r["event_name"], r["image_id"]) for r in files.gallery(spark, str(tree)).drop("content").collect()}
    assert got == {("A", "data/events/A/Gallery/sub/z.avif"), ("A", "data/events/A/Gallery/broken.jpg"), ("b Event", "data/events/b Event/Gallery/sub/x 1.jpg"), ("b Event", "data/events/b Event/Gallery/sub/y+2.PNG")}
    refs = files.reference_images(spark, str(tree)).collect()
    assert sorted((r["event_name"], r["reference_ord"], r["image_path"].rsplit("/", 1)[1]) for r in refs) == [("A", 1, "Ann - 123.jpg"), ("b Event", 1, "Ann - 123.jpg")]
    with pytest.raises(FileNotFoundError):
        files.events(spark, str(tree / "nowhere"))


def test_images_to_observations(spark, tree):
    found = observe.detect(files.gallery(spark, str(tree)), decode, persons, faces, encode).cache()
    assert [(r["image_id"][-10:], r["error"]) for r in observe.failures(found).collect()] == [("broken.jpg", "ValueError: Could not read image")]
    rows = observe.observe(found).collect()
    assert len(rows) == 1 + 1 + 2 and {r["observation_type"] for r in rows} == {"face_and_body", "face_only"}
    by = {(r["event_name"], r["observation_id"]): r for r in rows}
    two = [r for r in rows if r["image_id"].endswith("y+2.PNG")]
    assert sorted((r["observation_type"], round(r["association_score"], 3)) for r in two) == [("face_and_body", 1.0), ("face_only", 0.0)]
    one = by["A", 0]
    assert one["face_embedding_valid"] and one["body_embedding_valid"] and one["face_embedding"] == [1.0, 0.0, 0.0, 0.0] and one["face_pose"] == "frontal"
    assert one["face_quality"] == pytest.approx(0.4 * 0.9 + 0.3 * (5 / 80) + 0.3)


def test_streaming_ingest_sees_each_file_once(spark, tree, tmp_path):
    def work(batch):
        found = observe.detect(batch, decode, persons, faces, encode)
        return observe.observe(found), observe.failures(found)

    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")

    def go():
        q = ingest.ingest(ingest.image_stream(spark, str(tree)), work, out, mark)
        q.awaitTermination(120)
        return spark.read.parquet(f"{out}/observations")

    first = go()
    assert first.count() == 4 and spark.read.parquet(f"{out}/failed").count() == 1
    (tree / "data/events/A/Gallery/new.jpg").write_bytes(image(3))
    rows = go().collect()
    assert len(rows) == 5 and len({(r["event_name"], r["observation_id"]) for r in rows}) == 5


def test_job_states_by_window(spark, tmp_path):
    rows = [("E", 1, "DONE", 0), ("E", 2, "DONE", 60), ("E", 2, "DONE", 70), ("E", 3, "FAILED", 900), ("E", 4, "DONE", 5000)]
    df = spark.createDataFrame(rows, "event_name string, job_id long, status string, s long").selectExpr("event_name", "job_id", "status", "timestamp_seconds(s) as at")
    df.write.parquet(str(tmp_path / "in"))
    q = ingest.latest_states(ingest.job_events(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName("states").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["status"], r["jobs"]) for r in spark.table("states").collect()}
    assert got == {("DONE", 2), ("FAILED", 1)}


def test_sqlite_import(spark, tmp_path):
    paths = {}
    for e in ("A", "B"):
        paths[e] = str(tmp_path / f"{e}.db")
        db = sqlite3.connect(paths[e])
        db.execute("create table image_jobs (job_id integer, status text)")
        db.executemany("insert into image_jobs values (?, ?)", [(n, "FAILED") for n in range(3)])
        db.commit()
        db.close()
    df = sqlite.read(spark, paths, "image_jobs", "event_name string, job_id long, status string, worker_id string")
    assert sorted(tuple(r) for r in df.collect()) == [(e, n, "FAILED", None) for e in "AB" for n in range(3)]


def test_workbook(spark, tmp_path):
    rows = spark.createDataFrame([("E", "Zoë & Co", "123", "https://x/?a=1&b=2"), ("E", "Ann", "", ""), ("F", "no", "", "")], "event_name string, name string, phone string, link string")
    path = str(tmp_path / "r.xlsx")
    assert xlsx.save_report(rows.orderBy("name"), "E", path) == 2
    with zipfile.ZipFile(path) as z:
        parts = {n: ElementTree.fromstring(z.read(n)) for n in z.namelist()}
    texts = [t.text or "" for t in parts["xl/worksheets/sheet1.xml"].iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}t")]
    assert texts == ["Name", "Phone", "Link", "Ann", "", "", "Zoë & Co", "123", "https://x/?a=1&b=2"]
    assert [r.get("Target") for r in parts["xl/worksheets/_rels/sheet1.xml.rels"]] == ["https://x/?a=1&b=2"]


def test_manifest_copies(spark, tree, tmp_path):
    rows = [("A", "Ann", "All Images", "data/events/A/Gallery/sub/z.avif", "z.avif"), ("A", "Ann", "All Images", "data/events/A/Gallery/gone.jpg", "gone.jpg")]
    df = spark.createDataFrame(rows, "event_name string, person_folder string, kind string, source string, dest_name string")
    got = {r["dest_name"]: r["status"] for r in manifest.copy_files(df, str(tree), str(tmp_path / "o")).collect()}
    assert got == {"z.avif": "copied", "gone.jpg": "missing"} and (tmp_path / "o/A/Ann/All Images/z.avif").read_bytes() == image(0)


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text("# c\nA = 'x=1'\nB=2\nno pair\n")
    assert settings.read_env(str(env)) == {"A": "x=1", "B": "2"}
    settings.write_env(str(env), {"B": "3", "C": "4"})
    assert settings.read_env(str(env)) == {"A": "x=1", "B": "3", "C": "4"}
    py = tmp_path / "c.py"
    py.write_text("é = 1\nX = 1  # keep\nY = (1,\n     2)\nX = 2\nZ = f()\n", encoding="utf-8")
    assert settings.read_constants(str(py)) == {"é": 1, "X": 2, "Y": (1, 2)}
    settings.write_constants(str(py), {"X": 5, "Y": [3]})
    assert settings.read_constants(str(py)) == {"é": 1, "X": 5, "Y": [3]} and "X = 1  # keep" in py.read_text(encoding="utf-8") and (tmp_path / "c.py.bak").exists()
    with pytest.raises(KeyError):
        settings.write_constants(str(py), {"NEW": 1})


def test_blobs(spark):
    df = spark.createDataFrame([([1.5, -2.0],), ([],), (None,)], "v array<float>").withColumn("b", blobs.encode("v"))
    assert [r[0] for r in df.select(blobs.decode(F.col("b"), F.size("v"))).collect()] == [[1.5, -2.0], None, None]
    with pytest.raises(Exception, match="2 numbers where 3 were stored"):
        df.limit(1).select(blobs.decode(F.col("b"), F.lit(3))).collect()


JOBS = "event_name string, job_id long, image_id string, image_path string, status string, worker_id string, attempts long, created_at double, started_at double, completed_at double, error_message string"


def test_job_edges(spark):
    rows = [("E", 1, "a", "a", "PROCESSING", "w1", 1, 0.0, 400.0, None, None), ("E", 2, "b", "b", "PROCESSING", "w1", 1, 0.0, 399.9, None, None), ("E", 3, "c", "c", "FAILED", "w1", 1, 0.0, 1.0, 2.0, "x"), ("E", 4, "d", "d", "FAILED", "w1", 2, 0.0, 1.0, 2.0, "x")]
    df = spark.createDataFrame(rows, JOBS)
    assert {r["job_id"]: (r["status"], r["attempts"]) for r in jobs.recover_stale(df, 1000.0).collect()} == {1: ("PROCESSING", 1), 2: ("PENDING", 1), 3: ("FAILED", 1), 4: ("FAILED", 2)}
    assert {r["job_id"]: r["status"] for r in jobs.retry_failed(df).collect()} == {1: "PROCESSING", 2: "PROCESSING", 3: "PENDING", 4: "FAILED"}
    done = spark.createDataFrame([("E", 1, "w2", None), ("E", 2, "w1", "oops"), ("E", 9, "w1", None)], "event_name string, job_id long, worker string, error string")
    assert {r["job_id"]: (r["status"], r["error_message"]) for r in jobs.finish(df, done, 5.0).collect()} == {1: ("PROCESSING", None), 2: ("FAILED", "oops"), 3: ("FAILED", "x"), 4: ("FAILED", "x")}
    assert sorted(r["job_id"] for r in jobs.refused(df, done).collect()) == [1, 9]
    with pytest.raises(RuntimeError, match="2 PROCESSING"):
        jobs.check_complete(df)
    jobs.check_complete(df.where("status = 'FAILED'"))
    images = spark.createDataFrame([("E", "a", "p"), ("E", "n", "p"), ("E", "n", "p"), ("F", "a", "p")], "event_name string, image_id string, image_path string")
    assert sorted((r["event_name"], r["image_id"], r["job_id"]) for r in jobs.enqueue(df, images, 0.0).collect()) == [("E", "n", 5), ("F", "a", 1)]


def test_state_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("A", 1), ("B", 2)], "event_name string, x int")
    state.write_events(df, path)
    state.write_events(spark.createDataFrame([("B", 5)], "event_name string, x int"), path)
    assert sorted((r["event_name"], r["x"]) for r in spark.read.parquet(path).collect()) == [("A", 1), ("B", 5)]
    old, new = df, spark.createDataFrame([("B", 2), ("C", 3)], "event_name string, x int")
    assert state.upsert(old, new, ["event_name"]).count() == 3
    assert state.add_missing(df, {"x": "int", "y": "double"}).columns == ["event_name", "x", "y"]


def test_colliding_names(spark):
    box = {"x1": 0, "y1": 0, "x2": 50, "y2": 50}
    rows = [("E", c, f"d{o}/IMG.jpg", o, 0.9, 0.9, 0.9, 0.5, pose, box) for o, c, pose in ((1, 0, "frontal"), (2, 0, "left"), (3, 1, None), (4, 1, "frontal"))]
    df = spark.createDataFrame(rows, "event_name string, cluster_id long, image_id string, observation_id long, face_quality double, face_detection_confidence double, person_detection_confidence double, association_score double, face_pose string, face_bbox struct<x1:int,y1:int,x2:int,y2:int>")
    named = spark.createDataFrame([("E", 0, "Ann"), ("E", 1, "Ann")], "event_name string, cluster_id long, person_name string")
    got = sorted(r["dest_name"] for r in selection.person_manifest(df, named).where("kind = 'All Images'").collect())
    assert got == ["IMG.jpg", "IMG_2.jpg", "IMG_3.jpg", "IMG_4.jpg"]


def test_whole_engine(spark):
    d = "/root/testdata/sf0.001"
    from gleaner.operators import matching

    obs, refs = fixtures.observations(spark, d), matching.references(fixtures.reference_faces(spark, d))
    out = engine.resolve(obs, refs)
    assert out.assignments.count() == out.observations.count() == 500
    right = out.matches.where("accepted").join(out.observations, ["event_name", "cluster_id"]).selectExpr("person_name = concat('Person ', true_person) as ok").collect()
    assert len(right) > 200 and all(r["ok"] for r in right)
    names = {r["name"] for r in out.report.collect()}
    assert names and names <= {f"Person {n}" for n in range(20)} and out.manifest.where("kind = 'Best Images'").count() > 0
