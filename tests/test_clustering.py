"""The distributed agglomeration against a plain global one, and its invariants."""

import numpy as np

from gleaner.config import DEFAULT as C
from gleaner.config import POSES
from gleaner.operators import clustering
from gleaner.plans import fixtures

COLS = "event_name string, observation_id long, image_id string, face_pose string, face_yaw double, face_quality double, face_detection_confidence double, face_bbox struct<x1:int,y1:int,x2:int,y2:int>, face_embedding_valid boolean, body_embedding_valid boolean, face_embedding array<double>, body_embedding array<double>"


def event(name, rng, n):
    people = rng.normal(size=(max(1, n // 4), 12))
    rows = []
    for i in range(n):
        v = people[rng.integers(len(people))] + rng.normal(size=12) * rng.choice([0.25, 0.5, 0.7])
        pose = rng.choice([*POSES, "unknown"], p=[0.45, 0.15, 0.15, 0.15, 0.1])
        rows.append((name, i, f"img{rng.integers(0, n)}", None if pose == "unknown" else str(pose), float(rng.integers(0, 25)), float(rng.uniform(0.3, 1)), float(rng.uniform(0.4, 1)), {"x1": 0, "y1": 0, "x2": int(rng.integers(30, 90)), "y2": 90}, bool(rng.random() < 0.95), bool(rng.random() < 0.6), (v / np.linalg.norm(v)).tolist(), rng.normal(size=6).tolist()))
    return rows


class Plain:
    """All pairs of clusters are looked at again after every merge."""

    def __init__(self, rows):
        rows = sorted((r for r in rows if r[8]), key=lambda r: r[1])
        self.r = rows
        self.q = [0.7 * r[5] + 0.3 * r[6] for r in rows]
        self.anchor = [r[3] == "frontal" and r[5] >= 0.5 and r[6] >= 0.5 and r[7]["x2"] >= 40 and abs(r[4]) <= 20 for r in rows]

    def cross(self, a, b):
        x, y = self.r[a][3], self.r[b][3]
        return x in POSES and y in POSES and x != y

    def pair(self, a, b):
        ra, rb = self.r[a], self.r[b]
        f = float(np.clip(np.dot(ra[10], rb[10]), -1, 1))
        body = None
        if ra[9] and rb[9]:
            x, y = np.array(ra[11]), np.array(rb[11])
            body = float(np.clip(x @ y / np.linalg.norm(x) / np.linalg.norm(y), -1, 1))
        if f < (0.6 if self.cross(a, b) else 0.55):
            return None
        q = (self.q[a] + self.q[b]) / 2
        s = 0.75 * f + 0.25 * q if body is None else 0.65 * f + 0.2 * (body + 1) / 2 + 0.15 * q
        return None if self.cross(a, b) and s < 0.75 else min(1.0, max(0.0, s))

    def reps(self, m):
        out, n = [], {}
        for i in sorted(m, key=lambda i: (not self.anchor[i], -self.q[i], i)):
            p = self.r[i][3]
            if p in POSES:
                if n.get(p, 0) == 3:
                    continue
                n[p] = n.get(p, 0) + 1
            out.append(i)
        return out[:3]

    def pairs(self, m, o):
        return [(s, i, j) for i in self.reps(m) for j in self.reps(o) if self.r[i][2] != self.r[j][2] and (s := self.pair(i, j)) is not None]

    def images(self, m):
        return {self.r[i][2] for i in m}

    def run(self):
        cl = {i: [i] for i in range(len(self.r))}
        while True:
            best = None
            for a in cl:
                for b in cl:
                    if a < b and any(self.anchor[i] for i in cl[a] + cl[b]) and not self.images(cl[a]) & self.images(cl[b]) and (ps := self.pairs(cl[a], cl[b])):
                        top = max(s for s, *_ in ps)
                        best = min(best or (2,), (-top, a, b))
            if best is None:
                break
            s, a, b = -best[0], *best[1:]
            i, j = next((i, j) for t, i, j in self.pairs(cl[a], cl[b]) if abs(t - s) <= 1e-6)
            if s < (0.75 if self.cross(i, j) else 0.78):
                break
            cl[a] += cl.pop(b)
        good = {a: m for a, m in cl.items() if len(m) > 1 and any(self.anchor[i] for i in m)}
        for i in [i for a, m in cl.items() if a not in good for i in m]:
            best = None
            for a, m in good.items():
                if self.r[i][2] in self.images(m):
                    continue
                ps = [(s, -n, r) for n, r in enumerate(self.reps(m)) if self.r[r][2] != self.r[i][2] and (s := self.pair(i, r)) is not None]
                if ps and (t := max(ps))[0] >= (0.75 if self.cross(i, t[2]) else 0.78) and (best is None or t[0] > best[0]):
                    best = (t[0], a)
            if best:
                good[best[1]].append(i)
        order = sorted(good.values(), key=min)
        return {self.r[i][1]: n for n, m in enumerate(order) for i in m}


def test_distributed_equals_global(spark):
    rng = np.random.default_rng(11)
    events = {f"E{n}": event(f"E{n}", rng, int(rng.integers(4, 19))) for n in range(150)}
    obs = spark.createDataFrame([r for rows in events.values() for r in rows], COLS)
    got = clustering.cluster(obs, C).collect()
    assert len(got) == sum(map(len, events.values()))
    found = {}
    for r in got:
        if r["cluster_id"] is not None:
            found.setdefault(r["event_name"], {})[r["observation_id"]] = r["cluster_id"]
    wrong = [e for e, rows in events.items() if Plain(rows).run() != found.get(e, {})]
    assert wrong == []
    assert sum(len(v) for v in found.values()) > 200


def test_invariants_on_the_fixture(spark):
    obs = fixtures.observations(spark, "/root/testdata/sf0.001")
    out = clustering.cluster(obs, C).join(obs.drop("cluster_id"), ["event_name", "observation_id"])
    from gleaner.functions import quality as Q

    rows = out.withColumn("anchor", Q.is_anchor(C)).where("cluster_id is not null").collect()
    groups = {}
    for r in rows:
        groups.setdefault((r["event_name"], r["cluster_id"]), []).append(r)
    assert all(len({r["image_id"] for r in g}) == len(g) >= 2 and any(r["anchor"] for r in g) for g in groups.values())
    assert all(len({r["true_person"] for r in g}) == 1 for g in groups.values())
    for e in {k[0] for k in groups}:
        ids = sorted(k[1] for k in groups if k[0] == e)
        firsts = [min(r["observation_id"] for r in groups[e, i]) for i in ids]
        assert ids == list(range(len(ids))) and firsts == sorted(firsts)
    assert 270 <= len(rows) <= 330  # 298 without recovery


def test_edges(spark):
    v = [1.0, 0.0]
    make = lambda e, i, img, pose, vec=v, q=0.9: (e, i, img, pose, 0.0, q, 0.9, {"x1": 0, "y1": 0, "x2": 80, "y2": 80}, True, False, vec, None)
    rows = [make("same", 0, "a", "frontal"), make("same", 1, "a", "frontal"), make("profile", 0, "a", "profile"), make("profile", 1, "b", "profile", [0.99, 0.14])]
    rows += [make("two", 0, "a", "frontal"), make("two", 1, "b", "frontal"), make("null", 0, "a", "frontal", None), make("null", 1, "b", "frontal", [0.0, 0.0])]
    got = {(r["event_name"], r["observation_id"]): r["cluster_id"] for r in clustering.cluster(spark.createDataFrame(rows, COLS), C).collect()}
    assert got == {("same", 0): None, ("same", 1): None, ("profile", 0): None, ("profile", 1): None, ("two", 0): 0, ("two", 1): 0, ("null", 0): None, ("null", 1): None}
    assert clustering.cluster(spark.createDataFrame([], COLS), C).count() == 0


def test_standing_merges_stop_at_the_first_failure(spark):
    rows = [("E", 0, 0, 0.9, 0, 1, True), ("E", 0, 1, 0.76, 0, 2, False), ("E", 5, 0, 0.8, 5, 6, True), ("E", 5, 1, 0.75, 5, 7, True), ("E", 5, 2, 0.95, 5, 8, True), ("F", 0, 0, 0.76, 0, 1, True)]
    kept = clustering.standing(spark.createDataFrame(rows, "event_name string, component long, seq long, score double, id1 long, id2 long, merged boolean"))
    assert sorted((r["event_name"], r["id1"], r["id2"]) for r in kept.collect()) == [("E", 0, 1), ("E", 5, 6), ("F", 0, 1)]
