"""Vector searches, near-duplicates, mixing and the pipeline: against brute force and at their edges."""

import re
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from gleaner.llm import ann, impact, mixing, simhash
from gleaner.llm.components import components

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"


def brute(x, ids, q, k=20):
    s = x @ q
    return s, np.lexsort((ids, -s))[:k]


def load(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)


def test_ann_recall_and_scores(spark):
    ids, x = load(spark)
    got = defaultdict(list)
    for r in ann.query(spark, SF).collect():
        got[r["query_id"]].append(r)
    hits = 0
    assert set(got) == {i for i in ids if i % 20 == 0}
    for q, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        at = int(np.flatnonzero(ids == q)[0])
        s, _ = brute(x, ids, x[at])
        s[at] = -np.inf
        want = set(ids[np.argsort(-s)[:20]])
        hits += len(want & {r["vec_id"] for r in rows})
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and q not in {r["vec_id"] for r in rows}
        assert all(abs(r["score"] - s[int(np.flatnonzero(ids == r["vec_id"])[0])]) < 1e-12 for r in rows)
    assert hits / (20 * len(got)) >= 0.9


def test_ann_visits_a_part_of_the_rows():
    """On 10,000 rows without structure: the rows in the visited buckets, and the recall among them."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(10_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    hashes = ann.Hashes(64, len(x), 1.0)
    buckets = hashes.buckets(hashes.place(hashes.lift(x, False)))
    share, hits = [], 0
    for i in range(60):
        s = x @ x[i]
        s[i] = -np.inf
        top = np.argsort(-s)[:20]
        probes = hashes.probes(hashes.place(hashes.lift(x[i][None], True))[0], float((2 - 2 * s[top[-1]]) ** 0.5))
        seen = np.isin(buckets, probes).any(1)
        share.append(seen.mean())
        hits += seen[top].sum()
    assert hits >= 0.9 * 60 * 20 and np.mean(share) < 0.7


def test_probes_come_in_the_order_of_their_estimate():
    rng = np.random.default_rng(7)
    hashes = ann.Hashes(8, 64, 1.0)
    place = hashes.place(rng.normal(size=(1, 9)))[0]
    probes = hashes.probes(place, 0.8)
    own = hashes.buckets(place[None])[0]
    assert set(own.tolist()) <= set(probes.tolist()) and len(set(probes.tolist())) == len(probes)
    # By drawing neighbours: earlier buckets of the first table are met more often.
    drawn = place[None, 0] + rng.normal(size=(200_000, hashes.count)) * 0.8 / ann.WIDTH
    met = (np.floor(drawn).astype(np.int64).view(np.uint64) * hashes.factor[0]).sum(1, dtype=np.uint64) + hashes.table[0]
    values, n = np.unique(met, return_counts=True)
    often = dict(zip(values.tolist(), n.tolist(), strict=True))
    first = [often.get(p, 0) for p in probes.tolist()[:12]]
    assert all(a >= 0.9 * b for a, b in zip(first, first[1:], strict=False)) and sum(often.get(p, 0) for p in probes.tolist()) >= 0.3 * 200_000


def test_a_vector_that_a_third_of_the_rows_share(spark, monkeypatch):
    """Its bucket is dealt in slices and its visitors in blocks; ties go to the smaller ids."""
    monkeypatch.setattr(ann, "PART", 64)
    monkeypatch.setattr(ann, "QUERIES", 16)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 12))
    x[::3] = x[0]
    x[5], x[7] = np.nan, 0
    rows = ann.nearest(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)).collect()
    got = defaultdict(dict)
    for r in rows:
        got[r["query_id"]][r["rank"]] = r["vec_id"]
    assert set(got) == set(range(0, 1200, 20)) and all(sorted(v) == list(range(1, 21)) for v in got.values())
    f = x.astype(np.float32).astype(float)
    ids, hits = np.arange(1200), 0
    for q, v in got.items():
        s = np.nan_to_num(f @ f[q], nan=-np.inf)
        s[[q, 7]] = -np.inf
        hits += len(set(np.lexsort((ids, -s))[:20].tolist()) & set(v.values()))
    assert hits >= 0.9 * 20 * len(got)


def test_sql_says_the_same(spark):
    import duckdb

    from gleaner.llm import queries

    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, text in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, SF)
        cols = sorted(df.columns)
        found = con.execute(text)
        names = [c[0] for c in found.description]
        assert sorted(names) == cols
        assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in cols) for r in found.fetchall())
    # What SQL can say of a mixture: sizes, and targets by filling round by round.
    sizes = "SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents"
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, size, sum(size) OVER (PARTITION BY source)::BIGINT FROM ({sizes})").fetchall()}
    assert {r["doc_id"]: (r["size"], r["source_size"]) for r in mixing.query(spark, SF).collect()} == want


def test_impact_search_is_exact(spark):
    ids, x = load(spark)
    z = np.floor(64 * x)
    got = defaultdict(list)
    for r in impact.query(spark, SF).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q, rows in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        s = z @ z[at]
        s[at] = -np.inf
        top = np.lexsort((ids, -s))[:20]
        assert sorted(rows) == [(n + 1, int(ids[i]), int(s[i])) for n, i in enumerate(top)]


@pytest.mark.parametrize("k", [1, 5])
def test_index_proof_on_small_impacts(k):
    rng = np.random.default_rng(k)
    for _ in range(30):
        z = np.floor(rng.normal(0, 3, (rng.integers(1, 60), 6)))
        q = np.floor(rng.normal(0, 3, 6))
        rows, s = impact.Index(z).search(q, k, -np.inf, -1)
        want = np.lexsort((np.arange(len(z)), -(z @ q)))[:k]
        assert rows[np.lexsort((rows, -s))[:k]].tolist() == want.tolist()


def drawn(rng, kind, n, dims):
    """Impacts of n rows."""
    z = {
        "small": lambda: rng.integers(-1, 2, (n, dims)),
        "sparse": lambda: rng.normal(0, 9, (n, dims)) * (rng.random((n, dims)) < 0.1),
        "large": lambda: rng.normal(0, 2.0**20, (n, dims)),
        "uneven": lambda: rng.normal(0, 5, (n, dims)) * 2.0 ** rng.integers(-3, 15, (n, 1)),
        "copies": lambda: rng.normal(0, 8, (3, dims))[rng.integers(0, 3, n)],
        "zero": lambda: np.zeros((n, dims)),
    }
    return np.floor(z[kind]()).astype(np.float64)


@pytest.mark.parametrize("kind", ["small", "sparse", "large", "uneven", "copies", "zero"])
def test_batches_lose_no_member(kind):
    """Whatever the bound is, among the rows of a batch's query are the best k that reach it, but for its own row."""
    rng = np.random.default_rng(11)
    for n, dims, k in ((1, 3, 2), (40, 5, 3), (900, 24, 20)):
        z, q = drawn(rng, kind, n, dims), drawn(rng, kind, 50, dims)
        own = rng.integers(-1, n, 50)
        q[own >= 0] = z[own[own >= 0]]
        scores = q @ z.T
        bound = np.where(rng.random(50) < 0.3, -np.inf, np.quantile(scores, rng.random(50)))
        for i, (rows, s) in enumerate(impact.Index(z).batch(q, k, bound, own)):
            others = np.flatnonzero(np.arange(n) != own[i])
            others = others[scores[i, others] >= bound[i]]
            want = others[np.lexsort((others, -scores[i, others]))[:k]]
            assert s.tolist() == scores[i, rows].tolist()
            assert rows[np.lexsort((rows, -s))[:k]].tolist() == want.tolist()


def test_most_queries_stop_before_the_last_level():
    """On 8,000 rows without structure, where later levels are spoilt."""
    rng = np.random.default_rng(5)
    z = np.floor(64 * (v := rng.normal(size=(8_000, 64))) / np.linalg.norm(v, axis=1)[:, None])
    q, rows = z[:200], z[200:]
    scores = q @ rows.T
    low = np.sort(scores[:, ::2], 1)[:, -20]
    index = impact.Index(rows)
    index.levels = [(d, p if not i else p * np.nan, r) for i, (d, p, r) in enumerate(index.levels)]
    found = index.batch(q, 20, low, np.full(200, -1))
    whole = [f[0].tolist() == np.flatnonzero(s >= b).tolist() for f, s, b in zip(found, scores, low, strict=True)]
    assert len(index.levels) > 1 and sum(whole) >= 180


def test_search_of_a_block_costs_a_few_sorts():
    """CPU time of 512 queries over a block, in sorts of its impacts: 15 at most, where queries served one by one took some 70."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(8_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z = np.floor(64 * x)
    ids, q = np.arange(len(x)), np.arange(512)
    low = np.sort(z[q] @ z[4000:].T, 1)[:, -20]
    left = pa.table({"id": ids, "x": pa.array(x.tolist(), pa.list_(pa.float64()))})
    right = pa.table({"id": q, "x": left["x"].take(q), "low": low})

    def cost(run):
        took = []
        for _ in range(3):
            start = time.thread_time()
            run()
            took.append(time.thread_time() - start)
        return min(took)

    search = impact._search(20)
    assert cost(lambda: search(left, right)) < 15 * cost(lambda: np.argsort(z, axis=0, kind="stable"))


EDGES = [(0, [1.0, 0.0], 0), (20, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.5, 0.5], 0), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (6, [float("nan"), 1.0], 0), (7, [float("inf"), 0.0], 0), (8, [1.0, None], 0), (9, [1.0, 2.0, 3.0], 0), (None, [1.0, 1.0], 0), (1, [1.0, 0.0], 0), (40, [0.0, 0.0], 0)]


def test_searches_at_their_edges(spark):
    vectors = spark.createDataFrame(EDGES, VECTORS).withColumn("id", F.lit(1)).withColumn("x", F.lit(2))
    a = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.nearest(vectors).collect())
    assert a == [(0, 1, 1), (0, 2, 20), (0, 3, 2), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    b = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in impact.top(vectors).collect())
    assert [x for x in b if x[0] == 0] == [(0, 1, 1, 4096), (0, 2, 20, 4096), (0, 3, 2, 2048), (0, 4, 5, 0), (0, 5, 40, 0)]
    assert [x[1:3] for x in b if x[0] == 40] == [(1, 0), (2, 1), (3, 2), (4, 5), (5, 20)]
    none = spark.createDataFrame([], VECTORS)
    assert ann.nearest(none).count() == 0 and impact.top(none).count() == 0


def test_few_rows_are_all_found(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 12, 21, 24):
        x = rng.normal(size=(n, 16)) * rng.uniform(0.1, 30, (n, 1))
        rows = ann.nearest(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)).where("query_id = 0").collect()
        assert len(rows) == min(20, n - 1) and (n > 21 or {r["vec_id"] for r in rows} == set(range(1, n)))


# SimHash


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(w[j : j + 4]) for j in range(max(1, len(w) - 3))] if w else []
    n = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            n[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * n[b] > len(sh))


def plain_components(fps, most=4):
    """fps: {key: fingerprint} -> {key: least key linked}"""
    keys, up = sorted(fps), {}
    for k in keys:
        up[k] = k

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    x = np.array([fps[k] for k in keys], np.uint64)
    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= most) + i + 1:
            a, b = find(keys[i]), find(keys[j])
            up[max(a, b)] = min(a, b)
    return {k: find(k) for k in keys}


def test_simhash_matches_plain_version(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    want = plain_components(fps)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.query(spark, SF).collect()}
    assert got == {d: (fps[d], want[d]) for d in fps}


def test_links_lose_nothing_in_crowded_cells(spark):
    rng = np.random.default_rng(8)
    fps = set()
    for centre in rng.integers(0, 2**63, 12, np.uint64):  # chains and clouds around centres
        v = int(centre)
        for _ in range(120):
            w = v
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                w ^= 1 << int(b)
            fps.add(w)
            v = w if rng.random() < 0.3 else v
    fps |= {0, 1, 2**64 - 1, 2**63}
    signed = {int(np.uint64(f).view(np.int64)): f for f in fps}
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(frame)).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for s in signed:
        got[roots.get(s, s)].add(s)
    for s, root in plain_components(signed).items():
        want[root].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert any(len(v) > 40 for v in want.values())
    blocks = {r["node"]: r["root"] for r in components(simhash.links(frame, crowd=6)).collect()}
    assert {s: blocks.get(s, s) for s in signed} == {s: roots.get(s, s) for s in signed}


def test_cells_of_a_batch_stream():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    cell = np.sort(rng.integers(0, 40, 900) ** 2 // 30)
    cell[200:600] = cell[200]
    cell.sort()
    row = np.arange(900)
    for cuts in ([], [1], [200, 300, 301, 599], sorted(rng.integers(0, 900, 30).tolist())):
        parts = [pa.RecordBatch.from_arrays([pa.array(c), pa.array(r)], ["cell", "row"]) for c, r in zip(np.split(cell, cuts), np.split(row, cuts), strict=True)]
        for most in (None, 100, 5):
            whole, large = [], []
            for done, (c, r) in simhash._whole_cells(iter(parts), most):
                (whole if done else large).append((c, r))
            assert sorted(np.concatenate([r for _, r in whole + large]).tolist()) == row.tolist()
            seen = [x for c, _ in whole for x in set(c.tolist())]
            assert len(seen) == len(set(seen)) and not set(seen) & {x for c, _ in large for x in c.tolist()}
            assert all(np.count_nonzero(cell == x) > most for c, _ in large for x in set(c.tolist()))


def test_manhattan_is_a_lower_bound():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 2**63, (2, 4000), np.uint64)
    count = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * s)) & np.uint64(3)) for s in range(32)]).astype(int)
    d = simhash._manhattan(simhash._counts(a), simhash._counts(b))
    assert (d == np.abs(count(a) - count(b)).sum(0)).all() and (d <= np.bitwise_count(a ^ b)).all()


def test_simhash_at_its_edges(spark):
    rows = [(5, None, "a", "b", 1), (3, "", "a", "b", 1), (9, " \n", "a", "b", 1), (7, "one two", "a", "b", 1), (8, "ONE  two\n", "a", "b", 1), (7, "one two", "a", "b", 1), (None, "one two", "a", "b", 1), (None, "lonely text of its own here", "a", "b", 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(0)).withColumn("nth", F.lit(0)).withColumn("root", F.lit(0))
    out = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert len(out) == 8 and {c for d, _, c in out if d in (5, 3, 9)} == {3} and {f for d, f, _ in out if d in (5, 3, 9)} == {"0" * 16}
    assert {c for d, _, c in out if d in (7, 8)} == {7}
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), (False, 0), (True, 3), (True, 7)]
    none = spark.createDataFrame([], DOCS)
    assert simhash.near_duplicates(none).count() == simhash.representatives(none).count() == 0


def five_word_shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike_components(texts, least=0.8):
    """{key: text} -> {key: least key linked by equal words or five-word Jaccard of `least` or more}, by all pairs."""
    sets = {k: five_word_shingles(t) for k, t in texts.items()}
    keys, up = sorted(sets), {k: k for k in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    holders = defaultdict(list)
    for k in keys:
        for s in sets[k] or [""]:
            holders[s].append(k)
    tried = set()
    for same in holders.values():
        for n, j in enumerate(same):
            for i in same[:n]:
                if (i, j) not in tried:
                    tried.add((i, j))
                    a, b = sets[i], sets[j]
                    if a == b or len(a & b) >= least * len(a | b):
                        x, y = find(i), find(j)
                        up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_representatives_leave_one_of_each_alike_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = alike_components({r["doc_id"]: r["text"] for r in docs.collect()})
    kept = [r["doc_id"] for r in simhash.representatives(docs).select("doc_id").collect()]
    groups = defaultdict(list)
    for d in kept:
        groups[want[d]].append(d)
    assert len(kept) == len(set(kept)) and set(groups) == set(want.values()) and all(min(v) == g for g, v in groups.items())
    extra = len(kept) - len(groups)  # groups that the fingerprints did not connect
    assert extra <= 0.05 * (len(want) - len(groups))


def edited(words, n, rng):
    w = list(words)
    for i in rng.choice(len(w), n, replace=False):
        w[i] = f"new{rng.integers(1 << 30)}"
    return " ".join(w)


def test_representatives_in_a_crowd(spark, monkeypatch):
    """Many near copies of one text, some alike and some not, over several blocks: as by all pairs."""
    rng = np.random.default_rng(6)
    base = [f"w{rng.integers(1 << 30)}" for _ in range(300)]
    texts = {i: edited(base, int(rng.integers(0, 14)), rng) for i in range(120)} | {500 + i: edited(base, 40, rng) for i in range(20)}
    monkeypatch.setattr(simhash, "TILE", 8000)
    kept = [r["doc_id"] for r in simhash.representatives(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()]
    want = alike_components(texts)
    assert sorted(kept) == sorted(set(want.values()))
    assert 20 < len(kept) < 120
    blocks = simhash.representatives(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), crowd=16).collect()
    assert sorted(r["doc_id"] for r in blocks) == sorted(kept)


def test_representatives_go_by_row(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(3, a, 1, 2), (5, a, 1, 2), (5, b, 1, 2), (7, b + " thirteen " * 30, 1, 2), (8, "w " * 300_000, 1, 2), (9, "w  " * 300_000, 1, 2), (None, a, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int, row int")
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"][:4]) for r in kept.collect()) == [(0, "one "), (3, "one "), (5, "seve"), (7, "seve"), (8, "w w ")]


# Mixing


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mixture_meets_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mixture(docs).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) and r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    want = plain_targets(sizes)
    assert target == pytest.approx(want) and all(r["source_size"] == sizes[r["source"]] for r in rows)
    assert all(abs(taken[s] - want[s]) <= 0.05 * want[s] for s in want)
    again = {r["doc_id"]: r["taken"] for r in mixing.mixture(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_water_filling(spark):
    for sizes in ({"a": 10, "b": 1000, None: 500}, {"a": 0, "b": 7}, {"x": 100, "y": 1, "z": 1, "é": 50}):
        rows = [("n" if s is None else f"s{s}", n) for s, n in sizes.items()]
        got = {r["skey"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "skey string, source_size long")).collect()}
        assert got == pytest.approx({"n" if s is None else f"s{s}": t for s, t in plain_targets(sizes).items()})


def test_mixing_at_its_edges(spark):
    rows = [(1, None, "a", None, 0), (2, "", "a", "s", 0), (3, "one two", "a", "s", 0), (3, "one two", "a", "s", 0), (None, "x y z", "a", None, 0), (4, "w " * 20000, "a", "t", 0)] + [(10 + i, "a b c d", "a", "u", 0) for i in range(50)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("skey", "size", "copies", "row", "rest", "u")})
    out = mixing.mixture(docs)
    assert out.count() == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in out.collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"(\S+)"))))).first()[0] == out.agg(F.sum("taken")).first()[0]
    none = spark.createDataFrame([], DOCS)
    assert mixing.mixture(none).count() == mixing.mix(none).count() == 0


def plain_expected(sizes, target, cap=2.0):
    """Copies expected of each size: scale x size ** TILT up to the cap, the scale by halving."""
    each = lambda scale: [min(cap, scale * n**mixing.TILT) if n else 0.0 for n in sizes]
    lo, hi = 0.0, cap
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(e * n for e, n in zip(each(mid), sizes, strict=True)) < target else (lo, mid)
    return each(hi)


def test_documents_have_their_own_odds(spark):
    """Over many seeds each size is included about as often as it expects, and differently from the others."""
    sizes = [10] * 200 + [40] * 200 + [160] * 200
    docs = spark.createDataFrame([(i, "w " * n, "en", "s", 0) for i, n in enumerate(sizes)], DOCS)
    want = dict(zip(range(len(sizes)), plain_expected(sizes, 0.4 * sum(sizes)), strict=True))
    seen = defaultdict(list)
    for seed in range(4):
        for r in mixing.mixture(docs, (1,), 0.4, seed=seed).collect():
            seen[r["size"]].append(r["copies"])
            assert np.floor(want[r["doc_id"]]) <= r["copies"] <= np.ceil(want[r["doc_id"]])
    means = {n: float(np.mean(v)) for n, v in seen.items()}
    assert means[10] + 0.05 < means[40] < means[160] - 0.05, means
    assert all(abs(means[n] - want[i]) < 0.06 for i, n in enumerate(sizes)), (means, want)


def test_a_long_document_on_the_cut_leaves_no_gap(spark):
    """Short documents behind a long one that doesn't fit fill the source, as in a plain walk over all of them."""
    rows = [(i, "a b c d e", "en", "s", 0) for i in range(3000)] + [(4000 + i, "w " * 900, "en", "s", 0) for i in range(12)]
    rows += [(7000, "x y z", "en", "s", 0)] * 4 + [(None, "no id", "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    for seed in (1, 2, 3):
        base = mixing._sized(docs, "source", "text", seed)
        plan = mixing.plan(mixing.staged(base, "t"), (1,), 0.25).first()
        groups, found = defaultdict(int), base.collect()
        for r, rest in zip(found, plain_expected([r["size"] for r in found], plan["target"]), strict=True):
            assert 0 < rest < 1
            x = r["u"] / (1 - r["u"]) * (1 - rest) / rest
            groups[x / (1 + x), r["doc_id"] if r["doc_id"] is not None else -1, r["size"]] += r["size"]
        gap, want = plan["open"], set()
        for (v, d, n), words in sorted(groups.items()):
            if words <= gap:
                gap -= words
                want.add(d)
        out = mixing.mixture(docs, (1,), 0.25, seed=seed).collect()
        assert {-1 if r["doc_id"] is None else r["doc_id"] for r in out if r["copies"]} == want
        assert plan["target"] - sum(r["taken"] for r in out) == pytest.approx(gap) and gap < 5


# Components and the pipeline


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1000, 2000 + i) for i in range(300)] + [(5, 5), (7, 6), (6, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[2000 + i] == 1000 for i in range(300)) and got[7] == 6 and 5 not in got


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_filter(spark, docs, SF).cache()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    there = {r["doc_id"] for r in kept.collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in there for d in good) >= 0.98 * len(good) and sum(d in there for d, q in labels.items() if q == 0) <= 0.2 * (len(labels) - len(good))
    single = corpus_pipeline.near_duplicates(spark, kept, SF).cache()
    want = alike_components({r["doc_id"]: r["text"] for r in kept.collect()})
    left = [r["doc_id"] for r in single.collect()]
    assert set(want.values()) <= set(left) and len(left) - len(set(want.values())) <= 0.05 * (len(want) - len(set(want.values())))
    clean = corpus_pipeline.personal_data(spark, single, SF).cache()
    assert clean.columns == docs.columns and clean.count() == single.count()
    mixed = corpus_pipeline.mixture(spark, clean, SF).cache()
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 2
    pieces = corpus_pipeline.packed(spark, mixed, SF).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert all(r["n"] == r["t"] * counts[r["doc_id"]] for r in pieces) and {r["doc_id"] for r in pieces} == set(counts)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_stages_at_their_edges(spark, tmp_path):
    """Null and empty texts, repeated rows, null ids, columns of clashing names, empty tables: through all stages."""
    good = "the river runs slowly past the old mill and nobody minds it much today"
    rows = [(1, None, "en", "s", 0), (2, "", "en", None, 0), (3, good, "en", "s", 3), (3, good, "en", "s", 3), (None, good, "en", "t", 3), (4, f"{good} mail bob@x.example", "en", "t", 3), (5, "w " * 30_000, "en", "u", 0)]
    spark.createDataFrame([(3, 1, 0), (4, 0, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = {c: F.lit(1) for c in ("row", "spans", "score", "size", "fp", "node", "copies", "skey", "term", "whole")}
    for docs in (spark.createDataFrame(rows, DOCS).withColumns(extra), spark.createDataFrame([], DOCS).withColumns(extra)):
        columns, n = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path)).cache()
            assert docs.columns == columns, name
            assert (docs.count() > 0) == (n > 0), name
        assert (corpus_pipeline.packed(spark, docs, str(tmp_path)).count() > 0) == (n > 0)
