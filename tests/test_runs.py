"""Whole runs over the image queue, commits, uploads, pictures, and pairs dealt in blocks."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.config import DEFAULT as C
from gleaner.operators import clustering, jobs, matching, scoring, selection, state
from gleaner.operators.numbering import numbered
from gleaner.plans import engine, fixtures, observe
from gleaner.sources import files, manifest, settings, upload
from tests.test_sources import JOBS, decode, encode, faces, image, persons

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tree(tmp_path):
    picture = lambda n, k=1: io.BytesIO(image(n, k))
    upload.create_event(str(tmp_path), "Wedding: A", [("photos/x.jpg", picture(1, 2)), ("sub/y.jpg", picture(2)), ("Gallery/bad.jpg", io.BytesIO(b"bad")), ("gallery", picture(1))], [("any/Ann - 123.jpg", picture(3)), ("Bob - 4.jpg", io.BytesIO(b"bad"))])
    upload.create_event(str(tmp_path), "Lost", [("only.jpg", io.BytesIO(b"bad"))])
    return tmp_path


def test_uploads_lay_out_events(tree):
    event = tree / "data/events/Wedding_ A"
    assert sorted(str(p.relative_to(event)) for p in event.rglob("*") if p.is_file()) == ["Gallery/bad.jpg", "Gallery/sub/y.jpg", "Gallery/x.jpg", "reference/Ann - 123.jpg", "reference/Bob - 4.jpg"]
    with pytest.raises(FileExistsError):
        upload.create_event(str(tree), "Wedding? A", [])
    for name in ("../out.jpg", "/etc/out.jpg", "a\\..\\..\\out.jpg"):
        with pytest.raises(ValueError, match="below the event"):
            upload.create_event(str(tree), f"New {len(name)}", [(name, io.BytesIO(b""))])


@pytest.fixture
def store(spark, tree):
    found = files.gallery(spark, str(tree))
    empty = spark.createDataFrame([], JOBS)
    start = jobs.enqueue(empty, found.select("event_name", "image_id", F.col("path").alias("image_path")), 0.0)
    s = state.Store(spark, str(tree / "state"))
    none = observe.observe(observe.detect(found.where("false"), decode, persons, faces, encode))
    s.commit({"jobs": start, "observations": none}, 0)
    return s


def test_a_run_over_the_queue(spark, tree, store):
    def work(taken):
        images = files.gallery(spark, str(tree)).join(taken.select("event_name", "image_id"), ["event_name", "image_id"])
        found = observe.detect(images, decode, persons, faces, encode).cache()
        rows = observe.observe(found).withColumn("local_ord", F.col("observation_id"))
        return rows, observe.failures(found)

    clock = iter(range(1, 100))
    engine.work_off(store, "w", work, lambda: float(next(clock)), C)
    done = {(r["event_name"], r["image_id"].rsplit("/", 1)[1]): (r["status"], r["attempts"]) for r in store.read("jobs").collect()}
    assert done == {("Wedding_ A", "x.jpg"): ("COMPLETED", 1), ("Wedding_ A", "y.jpg"): ("COMPLETED", 1), ("Wedding_ A", "bad.jpg"): ("FAILED", 2), ("Lost", "only.jpg"): ("FAILED", 2)}
    assert sorted(r["observation_id"] for r in store.read("observations").collect()) == [0, 1, 2]
    images = files.reference_images(spark, str(tree))
    refs = matching.references(observe.reference_faces(images, decode, faces))
    assert [(r["person_name"], r["phone_number"], len(r["embedding"])) for r in refs.collect()] == [("Ann", "123", 4)]
    out, behind = engine.run(store, refs, images)
    assert [tuple(r) for r in behind.collect()] == [("Lost", "no image could be processed")]
    assert {r["event_name"] for r in out.observations.collect()} == {"Wedding_ A"}
    assert {(r["person_name"], r["phone_number"]) for r in matching.contacts(images).collect()} == {("Ann", "123"), ("Bob", "4")}


def test_commits_are_whole_or_nothing(spark, store):
    at = store.version()
    mine = store.read("jobs").limit(1).select("event_name", "job_id", F.lit("w").alias("worker"))
    at = store.commit({"jobs": jobs.claim(store.read("jobs"), mine, 1.0), "observations": store.read("observations")}, at)
    good = mine.withColumn("error", F.lit(None).cast("string"))
    obs = store.read("observations")
    with pytest.raises(RuntimeError, match="recovered or claimed"):
        state.save_and_complete(store, obs, good.withColumn("worker", F.lit("other")), 2.0)
    assert store.version() == at
    with pytest.raises(RuntimeError, match="no longer the newest"):
        store.commit({"jobs": store.read("jobs"), "observations": obs}, at - 1)
    assert state.save_and_complete(store, obs, good, 2.0) == at + 1
    assert store.read("jobs").where("status = 'COMPLETED'").count() == 1 and store.read("jobs", at).where("status = 'COMPLETED'").count() == 0


def test_retries():
    class Busy(Exception):
        status = 503

    class Gone(Exception):
        status = 404

    tried, waits = [], []

    def fails(error, times):
        def run():
            tried.append(1)
            if len(tried) <= times:
                raise error
            return "done"

        tried.clear()
        waits.clear()
        return run

    assert jobs.with_retry(fails(Busy(), 3), wait=waits.append) == "done" and waits == [1.0, 2.0, 4.0]
    assert jobs.with_retry(fails(ValueError(), 5), wait=waits.append) == "done" and waits == [1.0, 2.0, 4.0, 8.0, 10.0]
    with pytest.raises(Busy):
        jobs.with_retry(fails(Busy(), 9), 2, wait=waits.append)
    assert len(tried) == 3
    with pytest.raises(Gone):
        jobs.with_retry(fails(Gone(), 1), wait=waits.append)
    assert waits == []


def test_pictures_of_persons_and_clusters(spark, tree):
    box = lambda x: {"x1": x, "y1": 10, "x2": x + 40, "y2": 50}
    rows = [("Wedding_ A", 0, "data/events/Wedding_ A/Gallery/x.jpg", 1, True, 0.5, 0.9, box(0)), ("Wedding_ A", 0, "data/events/Wedding_ A/Gallery/sub/y.jpg", 2, True, 0.9, 0.9, box(50)), ("Wedding_ A", 1, "gone.jpg", 3, True, 0.9, 0.9, box(0)), ("Wedding_ A", 2, "gone.jpg", 4, True, 0.9, 0.9, {"x1": 5, "y1": 5, "x2": 5, "y2": 9})]
    schema = "event_name string, cluster_id long, image_id string, observation_id long, face_embedding_valid boolean, face_quality double, face_detection_confidence double, face_bbox struct<x1:int,y1:int,x2:int,y2:int>"
    obs = spark.createDataFrame(rows, schema).withColumns({"face_embedding": F.array(F.lit(1.0)), "face_pose": F.lit("frontal"), "face_yaw": F.lit(0.0), "person_detection_confidence": F.lit(0.9)})
    named = spark.createDataFrame([("Wedding_ A", 0, "Ann"), ("Wedding_ A", 1, "Bob")], "event_name string, cluster_id long, person_name string")
    sizes = obs.select("event_name", "image_id", F.lit(100).alias("width"), F.lit(80).alias("height")).distinct()
    people = selection.representative_crops(obs, named, sizes)
    assert {(r["person_folder"], r["source"][-5:], tuple(r["crop"])) for r in people.collect()} == {("Ann", "y.jpg", (40, 0, 100, 60)), ("Bob", "e.jpg", (0, 0, 50, 60))}
    out = str(tree / "out")
    write = lambda df: {r["dest_name"] + r[1]: r["status"] for r in manifest.write_crops(df, str(tree), out, decode, lambda x: x.tobytes()).collect()}
    assert write(people) == {"representative Image.jpgAnn": "written", "representative Image.jpgBob": "missing"}
    assert (tree / "out/Wedding_ A/Ann/representative Image.jpg").stat().st_size == 60 * 60
    assert write(selection.cluster_crops(obs, sizes)) == {"cluster_000.jpgrepresentatives": "written", "cluster_001.jpgrepresentatives": "missing"}


def test_the_largest_of_equal_reference_faces_counts(spark):
    box = lambda n: {"x1": 0, "y1": 0, "x2": n, "y2": n}
    rows = [("E", "Ann - 1.jpg", 0, 0.9, box(5), [1.0, 0.0]), ("E", "Ann - 1.jpg", 1, 0.9, box(9), [0.0, 1.0]), ("E", "Ann - 1.jpg", 2, 0.99, box(9), None)]
    got = matching.references(spark.createDataFrame(rows, "event_name string, image_path string, face_ord int, confidence double, bbox struct<x1:int,y1:int,x2:int,y2:int>, embedding array<double>"))
    assert [r["embedding"] for r in got.collect()] == [[0.0, 1.0]]


def test_pairs_are_the_same_in_any_number_of_blocks(spark, monkeypatch):
    obs = fixtures.observations(spark, SF)
    refs = matching.references(fixtures.reference_faces(spark, SF))
    assigned = fixtures.assignments(obs)

    def all_of():
        rows = scoring.prepared(obs, C)
        pairs = {(r["event_name"], r["observation_id_a"], r["observation_id_b"], round(r["score"], 9)) for r in scoring.pair_scores(rows, C).collect()}
        turned = {tuple(r) for r in clustering.rejections(rows, C).collect()}
        sims = {(r["event_name"], r["observation_id"], r["reference_ord"], round(r["score"], 9)) for r in matching.similarities(obs, assigned, refs).collect()}
        return pairs, turned, sims

    want = all_of()
    monkeypatch.setattr(scoring, "BLOCK", 16)
    assert scoring.dealt(obs).agg(F.max("blocks")).first()[0] == 8
    assert all_of() == want and all(want)


def test_numbers_over_several_ranges(spark):
    rng = np.random.default_rng(1)
    rows = [(f"E{int(e)}", int(i)) for i, e in enumerate(rng.integers(0, 3, 5000) ** 2)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(str(e), int(i)) for e, i in rows], "event_name string, x long").repartition(5)
    got = {(r["event_name"], r["x"]): r["nth"] for r in numbered(df, "event_name", ["x"], "nth").collect()}
    for e in {k[0] for k in got}:
        assert [got[e, x] for x in sorted(x for k, x in got if k == e)] == list(range(1, sum(k[0] == e for k in got) + 1))
    assert len(got) == 5000 and numbered(df.limit(0), "event_name", ["x"], "nth").count() == 0


def test_settings_as_they_stand(tmp_path):
    env = tmp_path / ".env"
    env.write_text("A='\"x\"'\nB=\"'y'\"\n")
    assert settings.read_env(str(env)) == {"A": '"x"', "B": "y"}
    settings.write_env(str(env), {"A": "1"})
    settings.write_env(str(env), {"A": "2"})
    assert (tmp_path / ".env.bak").read_text() == "A='\"x\"'\nB=\"'y'\"\n"
    py = tmp_path / "c.py"
    py.write_text("X = {[]: 1}\nY = -'a'\nZ = 3\n")
    assert settings.read_constants(str(py)) == {"Z": 3} and settings.read_constants(str(tmp_path / "none.py")) == {}
    with pytest.raises(RuntimeError, match="missing: main.py"):
        files.check_root(str(tmp_path), ("main.py", "c.py"))


def test_large_events_are_numbered_and_decoded(spark, tree):
    index = {(r["event_name"], r["image_id"]) for r in files.image_index(spark, str(tree)).collect()}
    assert ("Wedding_ A", "data/events/Wedding_ A/Gallery/sub/y.jpg") in index and len(index) == 4
    assert isinstance(decode(image(1)), np.ndarray)
