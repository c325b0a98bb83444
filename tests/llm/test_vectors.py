"""Operators on vectors against brute force."""

import numpy as np
import pytest

from auditlake.llm import caps, graph

VECTORS = "vec_id long, embedding array<float>, label int"


def make(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    for name in ("id", "v", "f", "n", "shard", "node", "part", "k1", "rank", "component"):
        df = df.selectExpr("*", f"'clash' AS {name}")
    return df


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 32)).astype(np.float32)
    x[100:140] = x[0] + 0.15 * rng.standard_normal((40, 32)).astype(np.float32)
    x[140:150] = x[140]
    out = [(i, x[i].tolist(), i % 2 if i < 100 or i >= 150 else 0) for i in range(300)]
    out += [(400, None, 0), (401, [0.0] * 32, 0), (402, [float("nan")] + [1.0] * 31, 0), (403, [None] + [1.0] * 31, 0), (404, [float("inf")] + [1.0] * 31, 0), (405, x[0].tolist(), None), (None, x[0].tolist(), 0), (406, (x[0] * 2).tolist(), 0), (0, x[0].tolist(), 0)]
    return out


def good(rows, labelled):
    return [r for r in rows if r[0] is not None and r[1] is not None and None not in r[1] and np.isfinite(np.array(r[1], float)).all() and np.any(r[1]) and (r[2] is not None or not labelled)]


def test_caps(spark, rows):
    use = good(rows, True)
    x = np.array([r[1] for r in use], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, lab = np.array([r[0] for r in use]), np.array([r[2] for r in use])
    link = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :]) & ~np.eye(len(x), dtype=bool)
    comp = ids.copy()
    while True:
        new = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    want = sorted(zip(ids.tolist(), link.sum(1).tolist(), comp.tolist(), strict=True))
    want += [(r[0], 0, r[0]) for r in rows if r not in use]
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in caps.near_vectors(make(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert caps.near_vectors(make(spark, [])).count() == 0
    assert all(r["kept"] for r in caps.near_vectors(make(spark, rows[400:])).collect())


def test_pairs_at_the_threshold_and_a_chain(spark):
    rng = np.random.default_rng(6)
    rows, n = [], 0
    unit = lambda v: v / np.linalg.norm(v)
    for least in (0.925, 0.9299, 0.9301, 0.935, 0.95):
        for _ in range(40):
            a, b = unit(rng.standard_normal(64)), rng.standard_normal(64)
            b = unit(b - (b @ a) * a)
            rows += [(n, a.tolist(), 1), (n + 1, (3 * (least * a + np.sqrt(1 - least**2) * b)).tolist(), 1)]
            n += 2
    a, b = unit(rng.standard_normal(64)), rng.standard_normal(64)
    b = unit(b - (b @ a) * a)
    rows += [(1000 + i, (np.cos(0.35 * i) * a + np.sin(0.35 * i) * b).tolist(), 1) for i in range(8)]  # each near the next only
    got = {r["vec_id"]: r for r in caps.near_vectors(make(spark, rows)).collect()}
    x = np.array([np.float32(r[1]) for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    assert [got[r[0]]["n_links"] for r in rows] == link.sum(1).tolist()
    assert all(got[1000 + i]["component_id"] == 1000 and got[1000 + i]["n_links"] == (1 if i in (0, 7) else 2) for i in range(8))


def test_large_buckets_meet_in_blocks(spark, rows, monkeypatch):
    monkeypatch.setattr(caps, "BLOCK", 8)
    split = sorted(map(str, caps.near_vectors(make(spark, rows)).collect()))
    monkeypatch.setattr(caps, "BLOCK", 1024)
    assert split == sorted(map(str, caps.near_vectors(make(spark, rows)).collect()))


def test_filters_find_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    a = rng.standard_normal((600, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.standard_normal((600, 64))
    n -= (n * a).sum(1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    f = caps.Filters(64, 50_000, 0.93)
    one, two = f.decode(a.astype(np.float32)), f.decode((0.93 * a + np.sqrt(1 - 0.93**2) * n).astype(np.float32))
    assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(one, two, strict=True)]) > 0.995


def test_filters_find_pairs_of_sparse_and_spiky_vectors():
    rng = np.random.default_rng(2)
    f = caps.Filters(64, 50_000, 0.93)
    for few in (1, 2, 4):
        a = 0.01 * rng.standard_normal((400, 64)) if few == 2 else np.zeros((400, 64))
        for row in a:
            row[rng.choice(64, few, replace=False)] += rng.choice([-1.0, 1.0], few)
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        n = rng.standard_normal((400, 64))
        n -= (n * a).sum(1, keepdims=True) * a
        n /= np.linalg.norm(n, axis=1, keepdims=True)
        one, two = f.decode(a.astype(np.float32)), f.decode((0.93 * a + np.sqrt(1 - 0.93**2) * n).astype(np.float32))
        assert np.mean([len(np.intersect1d(p, q)) > 0 for p, q in zip(one, two, strict=True)]) > 0.99, few


def brute(rows, queries, k):
    use = good(rows, False)
    x = np.array([r[1] for r in use], float)
    ids = np.array([r[0] for r in use])
    out = {}
    for q in dict((r[0], r) for r in good(queries, False)).values():
        v = np.array(q[1], float)
        s = (x * v).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((v * v).sum()))
        best = {}
        for i in np.lexsort((ids, -s)):
            if ids[i] != q[0] and len(best) < k:
                best.setdefault(int(ids[i]), float(s[i]))
        out[q[0]] = list(best.items())
    return out


def test_nearest(spark, rows):
    queries = [r for r in rows if r[0] is None or r[0] % 7 == 0 and r[0] or r[0] >= 400]
    for size in (10_000, 100):
        got = graph.nearest(make(spark, rows), make(spark, queries), shard_rows=size, query_rows=20).collect()
        by = {}
        for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
            by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        want = brute(rows, queries, 5)
        assert by.keys() == want.keys()
        hits = sum(len({a for a, _ in by[q]} & {a for a, _ in want[q]}) for q in want)
        assert hits >= 0.98 * 5 * len(want)
        assert all(abs(s - dict(want[q]).get(i, s)) < 1e-12 for q in by for i, s in by[q])
    few = make(spark, rows[:3])
    assert graph.nearest(few, few).count() == 6
    empty = make(spark, [])
    assert graph.nearest(empty, few).count() == 0 and graph.nearest(few, empty).count() == 0


def test_nearest_in_clusters_and_ties(spark):
    rng = np.random.default_rng(4)
    for noise in (0.1, 1e-3, 1e-5):
        middle = np.repeat(rng.standard_normal((10, 64)), 300, axis=0)
        x = (middle + noise * rng.standard_normal(middle.shape)).astype(np.float32)
        rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
        queries = rows[::50]
        want, by = brute(rows, queries, 5), {}
        for r in graph.nearest(make(spark, rows), make(spark, queries)).collect():
            by.setdefault(r["query_id"], set()).add(r["vec_id"])
        recall = [len(by[q] & {a for a, _ in want[q]}) / 5 for q in want]
        assert np.mean(recall) >= 0.95 and min(recall) >= 0.8, (noise, np.mean(recall), min(recall))
    v = rng.standard_normal(32).astype(np.float32)
    rows = [(i, (v * np.float32(2.0 ** (i % 20))).tolist(), 0) for i in range(101)] + [(200 + i, rng.standard_normal(32).astype(np.float32).tolist(), 0) for i in range(200)]
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in graph.nearest(make(spark, rows), make(spark, rows[:1])).collect())
    assert [g[:2] for g in got] == [(i, i) for i in range(1, 6)] and all(abs(g[2] - 1) < 1e-12 for g in got)


def test_recall_of_a_graph():
    x = np.random.default_rng(2).standard_normal((3000, 48)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges, entries = graph.build_graph(x)
    q = np.arange(0, 3000, 30)
    found, _ = graph.beam_search(x, edges, entries, x[q], 128)
    near = np.argsort(-(x[q] @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a[:6]) & set(b)) / 6 for a, b in zip(found.tolist(), near.tolist(), strict=True)]) >= 0.95
