"""Constrained greedy agglomeration, exact and distributed.

Two clusters may merge if they share no image and one of them holds a trusted anchor.  The best-scoring pair goes first; the
first pair that falls short of its threshold ends the whole run of its event, in whatever part of the data it is.  That makes
the loop global, but merges need a pair of observations that scores at least the lower threshold, so they never leave a
connected component of those pairs:

1. pairs that score enough (anchors or not) and their components, natively;
2. per component, the loop up to its own first failure: the sequence of merges with their keys (-score, id1, id2);
3. globally, components would be served in the order of the running maximum of these keys; so the failure with the least
   running maximum ends the event, and merges up to it stand - a window and an aggregate;
4. per component, the standing merges and then the recovery of what is left over; ids by first observation.

Pairs that score less than the lower threshold can't merge, and as failures they come after every merge, so the scores of
step 1 are all that steps 2 and 4 need: a task gets a component's observations without vectors, and its pairs.  Its size is
what the data connects, not what the table holds; steps 2 and 4 hold one component per task group.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, POSES, Config
from ..sources.scratch import staged
from . import scoring
from .numbering import numbered

_PREPARED = ("event_name", "observation_id", "image_id", "pose", "face", "body", "quality", "anchor")
#: Scores this close to the best one count as the pair that won.
NEAR = 1e-6


@dataclass
class _Cluster:
    id: int
    members: list[int]
    images: set[str]
    anchored: bool
    version: int = 0
    reps: list[int] = field(default_factory=list)


class Agglomeration:
    """The loop over the observations of one component and its scored pairs; members are positions in the order of observation_id."""

    def __init__(self, rows: pd.DataFrame, pairs: pd.DataFrame, c: Config):
        rows = rows.sort_values("observation_id", kind="stable")
        self.c = c
        self.ids = rows["observation_id"].tolist()
        self.image = rows["image_id"].tolist()
        self.pose = [p if p in POSES else None for p in rows["pose"]]
        self.quality = rows["quality"].tolist()
        self.anchor = rows["anchor"].astype(bool).tolist()
        at = {o: n for n, o in enumerate(self.ids)}
        #: For each member, those it scores with.
        self.near: list[dict[int, float]] = [{} for _ in self.ids]
        for a, b, s in zip(pairs["a"], pairs["b"], pairs["score"], strict=True):
            i, j = at[a], at[b]
            self.near[i][j] = self.near[j][i] = s
        self.clusters = {i: _Cluster(i, [i], {self.image[i]}, self.anchor[i]) for i in range(len(self.ids))}
        self.home = list(range(len(self.ids)))

    def cross(self, a: int, b: int) -> bool:
        return self.pose[a] is not None and self.pose[b] is not None and self.pose[a] != self.pose[b]

    def representatives(self, cluster: _Cluster) -> list[int]:
        if not cluster.reps:
            c, count, kept = self.c, {}, []
            ranked = sorted(cluster.members, key=lambda i: (not self.anchor[i], -self.quality[i], i))
            for i in ranked:
                if self.pose[i] is not None:
                    if count.get(self.pose[i], 0) >= c.per_pose:
                        continue
                    count[self.pose[i]] = count.get(self.pose[i], 0) + 1
                kept.append(i)
            many = 2 if c.representatives == 1 and self.anchor[ranked[0]] else c.representatives
            cluster.reps = kept[:many]
        return cluster.reps

    def _pairs(self, a: _Cluster, b: _Cluster) -> Iterator[tuple[float, int, int]]:
        for i in self.representatives(a):
            for j in self.representatives(b):
                if (s := self.near[i].get(j)) is not None:
                    yield s, i, j

    def neighbours(self, a: _Cluster) -> list[_Cluster]:
        """The other clusters with a member that a representative of a scores with."""
        return [self.clusters[i] for i in {self.home[j] for r in self.representatives(a) for j in self.near[r]} - {a.id}]

    def mergeable(self, a: _Cluster, b: _Cluster) -> bool:
        return (a.anchored or b.anchored) and a.images.isdisjoint(b.images)

    def threshold(self, a: _Cluster, b: _Cluster, best: float) -> float:
        crossed = next(self.cross(i, j) for s, i, j in self._pairs(a, b) if abs(s - best) <= NEAR)
        return self.c.cross_merge if crossed else self.c.merge

    def join(self, a: _Cluster, b: _Cluster) -> _Cluster:
        """b goes into a, the cluster of the smaller id."""
        a.members += b.members
        a.images |= b.images
        a.anchored = a.anchored or b.anchored
        a.version += 1
        a.reps = []
        for i in b.members:
            self.home[i] = a.id
        del self.clusters[b.id]
        return a

    def run(self) -> list[tuple[float, int, int, bool]]:
        """(score, id1, id2, merged) of each pair served; the last may be the failure that ends the loop."""
        heap: list[tuple[float, int, int, int, int]] = []

        def offer(a: _Cluster, b: _Cluster) -> None:
            if a.id > b.id:
                a, b = b, a
            if self.mergeable(a, b) and (best := max((s for s, *_ in self._pairs(a, b)), default=None)) is not None:
                heapq.heappush(heap, (-best, a.id, b.id, a.version, b.version))

        for a in self.clusters.values():
            for b in self.neighbours(a):
                if a.id < b.id:
                    offer(a, b)
        served = []
        while heap:
            key, i, j, vi, vj = heapq.heappop(heap)
            a, b = self.clusters.get(i), self.clusters.get(j)
            if a is None or b is None or (a.version, b.version) != (vi, vj):
                continue
            merged = -key >= self.threshold(a, b, -key)
            served.append((-key, i, j, merged))
            if not merged:
                break
            self.join(a, b)
            for other in self.neighbours(a):
                offer(a, other)
        return served

    def replay(self, merges: list[tuple[int, int]]) -> dict[int, int]:
        """observation_id -> first member's observation_id, after the given merges and the recovery of what is left."""
        for i, j in merges:
            self.join(self.clusters[i], self.clusters[j])
        targets = [x for x in self.clusters.values() if x.anchored and len(x.members) >= self.c.min_cluster]
        taken = {id(x) for x in targets}
        for i in [m for x in self.clusters.values() if id(x) not in taken for m in x.members]:
            best, home = -1.0, None
            for t in targets:
                if self.image[i] in t.images:
                    continue
                score, crossed = None, False
                for r in self.representatives(t):
                    s = self.near[i].get(r)
                    if s is not None and (score is None or s > score):
                        score, crossed = s, self.cross(i, r)
                if score is not None and score >= (self.c.cross_merge if crossed else self.c.merge) and score > best:
                    best, home = score, t
            if home is not None:
                home.members.append(i)
                home.images.add(self.image[i])
                home.reps = []
        return {self.ids[m]: min(self.ids[k] for k in t.members) for t in targets for m in t.members}


def _merges(c: Config) -> Callable:
    def run(rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        loop = Agglomeration(rows, pairs, c)
        served = loop.run()
        out = pd.DataFrame(served, columns=["score", "i", "j", "merged"])
        out["id1"] = [loop.ids[i] for i in out["i"]]
        out["id2"] = [loop.ids[j] for j in out["j"]]
        out["seq"] = range(len(out))
        out["event_name"], out["component"] = rows["event_name"].iloc[0], rows["component"].iloc[0]
        return out[["event_name", "component", "seq", "score", "id1", "id2", "merged"]].astype({"score": float, "id1": "int64", "id2": "int64", "seq": "int64", "merged": bool})

    return run


def _assigned(c: Config) -> Callable:
    def run(key: tuple, rows: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        merges = pairs[pairs["seq"].notna()].sort_values("seq")
        loop = Agglomeration(rows, pairs[pairs["seq"].isna()], c)
        at = {o: n for n, o in enumerate(loop.ids)}
        first = loop.replay([(at[a], at[b]) for a, b in zip(merges["a"], merges["b"], strict=True)])
        out = pd.DataFrame({"observation_id": list(first), "first_id": list(first.values())}, dtype="int64")
        out.insert(0, "event_name", key[0])
        return out

    return run


def component_labels(edges: DataFrame) -> DataFrame:
    """(event_name, a, b) -> event_name, observation_id, component (least id), by minimum labels with pointer jumping."""
    both = staged(edges.select("event_name", "a", "b").union(edges.select("event_name", F.col("b"), F.col("a"))).distinct(), "cluster")
    labels = staged(both.groupBy("event_name", F.col("a").alias("observation_id")).agg(F.least(F.col("observation_id"), F.min("b")).alias("component")), "cluster")
    while True:
        near = both.join(labels.withColumnRenamed("observation_id", "b"), ["event_name", "b"]).groupBy("event_name", F.col("a").alias("observation_id")).agg(F.min("component").alias("least"))
        step = staged(labels.join(near, ["event_name", "observation_id"]).select("event_name", "observation_id", F.col("component").alias("old"), F.least("component", "least").alias("component")), "cluster")
        jump = step.select("event_name", F.col("observation_id").alias("component"), F.col("component").alias("further"))
        labels = staged(step.join(jump, ["event_name", "component"]).select("event_name", "observation_id", "old", F.least("component", "further").alias("component")), "cluster")
        if labels.where("old <> component").isEmpty():
            return labels.select("event_name", "observation_id", "component")
        labels = labels.drop("old")


def standing(merges: DataFrame) -> DataFrame:
    """The merges that come before the first failure of their event."""
    key = F.struct((-F.col("score")).alias("s"), "id1", "id2")
    so_far = Window.partitionBy("event_name", "component").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    worst = merges.withColumn("worst", F.max(key).over(so_far))
    end = worst.where("not merged").groupBy("event_name").agg(F.min("worst").alias("end"))
    return worst.join(end, "event_name", "left").where(F.col("merged") & (F.col("end").isNull() | (F.col("worst") <= F.col("end")))).select("event_name", "component", "seq", "id1", "id2")


def cluster(obs: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """event_name, observation_id, cluster_id for every observation; null where it belongs to no confirmed cluster."""
    rows = staged(scoring.prepared(obs, c), "cluster")
    # Scores a little beneath the threshold may count as equal to one above.
    pairs = scoring.pair_scores(rows, c, anchored=False).where(F.col("score") >= c.edge - 2 * NEAR)
    pairs = staged(pairs.select("event_name", F.col("observation_id_a").alias("a"), F.col("observation_id_b").alias("b"), "score"), "cluster")
    labels = staged(component_labels(pairs), "cluster")
    key = ["event_name", "component"]
    grouped = staged(rows.drop("face", "body").join(labels, ["event_name", "observation_id"]), "cluster")
    pairs = staged(pairs.join(labels.withColumnRenamed("observation_id", "a"), ["event_name", "a"]).select(*key, "a", "b", "score"), "cluster")
    merges = grouped.groupBy(*key).cogroup(pairs.groupBy(*key)).applyInPandas(_merges(c), "event_name string, component long, seq long, score double, id1 long, id2 long, merged boolean")
    kept = standing(staged(merges, "cluster")).select(*key, F.col("id1").alias("a"), F.col("id2").alias("b"), F.lit(None).cast("double").alias("score"), "seq")
    both = pairs.withColumn("seq", F.lit(None).cast("long")).unionByName(kept)
    found = grouped.groupBy(*key).cogroup(both.groupBy(*key)).applyInPandas(_assigned(c), "event_name string, observation_id long, first_id long")
    return compact(obs, staged(found, "cluster"))


def compact(obs: DataFrame, found: DataFrame) -> DataFrame:
    """Cluster ids from 0 in the order of their first observation, for every observation."""
    ids = numbered(found.select("event_name", "first_id").distinct(), "event_name", ["first_id"], "nth")
    named = found.join(ids, ["event_name", "first_id"]).select("event_name", "observation_id", (F.col("nth") - 1).alias("cluster_id"))
    return obs.select("event_name", "observation_id").join(named, ["event_name", "observation_id"], "left")


def run_stats(obs: DataFrame, assignments: DataFrame) -> DataFrame:
    """Totals of a run per event."""
    from ..functions import quality as Q

    rows = obs.select("event_name", "observation_id", Q.is_valid_face().alias("valid")).join(assignments.select("event_name", "observation_id", "cluster_id"), ["event_name", "observation_id"], "left")
    return rows.groupBy("event_name").agg(
        F.count(F.lit(1)).alias("total_observations"), F.count_if("valid").alias("valid_face_observations"), F.count("cluster_id").alias("clustered_observations"),
        F.count_if(F.col("cluster_id").isNull()).alias("unknown_observations"), F.count_distinct("cluster_id").alias("cluster_count"),
    )


def rejections(rows: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """First-pass pairs per event that are turned down: not mergeable (same image or no anchor), or without a score."""
    pairs = scoring.every_pair(rows.select(*_PREPARED))
    barred = (F.col("image_id_a") == F.col("image_id_b")) | ~(F.col("anchor_a") | F.col("anchor_b"))
    pairs = scoring.scored(pairs.withColumn("barred", barred), c, keep_all=True)
    return pairs.groupBy("event_name").agg(F.count_if("barred").alias("rejected_same_image"), F.count_if(~F.col("barred") & F.col("score").isNull()).alias("rejected_low_similarity"))


def cluster_sizes(assignments: DataFrame) -> DataFrame:
    return assignments.where("cluster_id is not null").groupBy("event_name", "cluster_id").agg(F.count(F.lit(1)).alias("size"))


def conflicts(rows: DataFrame) -> DataFrame:
    """Pairs of clusters of an event that share an image; rows: event_name, cluster_id, image_id."""
    one = rows.select("event_name", "cluster_id", "image_id").distinct()
    other = one.withColumnRenamed("cluster_id", "cluster_2")
    return one.join(other, ["event_name", "image_id"]).where("cluster_id < cluster_2").select("event_name", F.col("cluster_id").alias("cluster_1"), "cluster_2").distinct()
