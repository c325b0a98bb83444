"""Centroid clustering, licence scan and phrase mining against brute force, on a sample and on odd rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext

from auditlake.llm import centroids, licences, phrases
from auditlake.llm.common import Scratch

from .conftest import make

VECS = "vec_id long, embedding array<float>, label int, cluster string, key string, v string, row string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, x, 1, "clash", "clash", "clash", "clash") for i, x in rows], VECS)


def k_means(rows, k, rounds, dims):
    """The contract, with Python integers."""
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in x]) for i, x in rows if x is not None and len(x) == dims and all(c is not None and np.isfinite(c) for c in x)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cs = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    own = lambda v: min(range(len(cs)), key=lambda c: (far(v, cs[c]), c))
    for _ in range(rounds):
        by = collections.defaultdict(list)
        for _, v in kept:
            by[own(v)].append(v)
        cs = [[sum(x) // len(by[c]) for x in zip(*by[c], strict=True)] if c in by else cs[c] for c in range(len(cs))]
    at = [(i, own(v), far(v, cs[own(v)])) for i, v in kept]
    inertia = collections.Counter()
    for _, c, d in at:
        inertia[c] += d
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in at), key=repr)


def found(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def test_centroids(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.25, 0.5, 0.25, -1.0]) for i in range(150)] + [(7, [0.5] * 4), (7, [0.5] * 4)]  # a hot vector, repeated rows
    rows += [(None, [0.1] * 4), (2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0, None, 1.0, 1.0]), (2004, [1.0, float("nan"), 1.0, 1.0]), (2005, [float("inf")] * 4), (2006, [0.0] * 4), (2007, [1e4, -1e5, 1e5, 3.0])]
    got = centroids.cluster_vectors(vectors(spark, rows), k=12, rounds=3, dims=4, size=16)
    assert found(got) == k_means(rows, 12, 3, 4)
    few = [(i, [float(i), 0.0]) for i in range(3)]  # fewer rows than centroids
    assert found(centroids.cluster_vectors(vectors(spark, few), k=12, rounds=2, dims=2)) == k_means(few, 12, 2, 2)
    assert centroids.cluster_vectors(vectors(spark, []), dims=4).collect() == []
    assert centroids.cluster_vectors(vectors(spark, [(None, [1.0] * 4)]), dims=4).collect() == []


def test_boxes_leave_few_centroids(spark):
    rng = np.random.default_rng(6)
    middles = rng.normal(size=(20, 8)) * 4
    rows = [(i, (middles[i % 20] + rng.normal(size=8) * 0.05).tolist()) for i in range(2000)]
    got = centroids.cluster_vectors(vectors(spark, rows), k=20, rounds=3, dims=8, size=32)
    assert found(got) == k_means(rows, 20, 3, 8)
    assert np.mean([r["candidates"] for r in got.collect()]) < 8


def test_candidates_hold_the_nearest():
    rng = np.random.default_rng(7)
    for _ in range(200):
        cs = rng.integers(-20, 20, (15, 3))
        m = rng.integers(-3, 4, (30, 3)) * rng.integers(1, 4) + rng.integers(-15, 15, 3)
        near = centroids.candidates(m.min(0), m.max(0), cs)
        own, distance = centroids.nearest_of(m, cs, near)
        far = ((m[:, None] - cs[None]) ** 2).sum(2)
        assert (own == far.argmin(1)).all() and (distance == far.min(1)).all()


def test_hilbert_curve_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 3), (5, 2)):
        points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = centroids.hilbert_keys(points, bits)
        along = points[sorted(range(len(keys)), key=keys.__getitem__)]
        assert len(set(keys)) == len(points) and (np.abs(np.diff(along, axis=0)).sum(1) == 1).all()


def test_equal_vectors_spread(spark):
    rows = [(i, [1.0, 2.0]) for i in range(4000)]
    scratch = Scratch(spark)
    kept = scratch.cut(spark.createDataFrame([(i, [256, 512]) for i, _ in rows], "vec_id long, v array<long>"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    blocks = centroids.zone_maps(kept, scratch, 2, 4, 64)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["n"] for r in blocks.selectExpr("size(ids) AS n").collect()) <= 64
    assert len({r["f"] for r in blocks.selectExpr("_metadata.file_name AS f").collect()}) > 1


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def base_of(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_licence_phrases(spark, sample, odd, none):
    tricky = ["MIT-License mit license,Apache_LICENSE general public license general public", "É mit licenseé MIT\nLicense", "the general public license general public license version", "GENERAL PUBLIC mit LICENSE"]
    for df in (sample, odd, make(spark, [(i, t, "en", "s", 1) for i, t in enumerate(tricky)])):
        want = sorted(((r["doc_id"], *base_of(r["text"])) for r in df.collect()), key=repr)
        assert sorted((tuple(r)[:6] for r in licences.licence_scan(df).collect()), key=repr) == want
    assert licences.licence_scan(none).count() == 0


def test_matching_statistics():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.choice(b"abc").to_bytes() for _ in range(rng.randrange(1, 14))] for _ in range(rng.randrange(1, 5))]
        named = {tuple(rng.choice(b"abcd").to_bytes() for _ in range(rng.randrange(1, 4))): str(i) for i in range(3)}
        auto = licences.Automaton(texts, named)
        words = [rng.choice(b"abcde").to_bytes() for _ in range(40)]
        runs = {tuple(t[i:j]) for t in (*texts, *named) for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        longest = [max([n for n in range(i + 1) if tuple(words[i - n : i]) in runs] or [0]) for i in range(len(words) + 1)]
        ends = [i for i in range(1, len(words) + 1) if longest[i] >= 2 and (i == len(words) or longest[i + 1] <= longest[i])]
        matches, phrases_found = auto.stream(words, 2)
        assert [(e, n) for e, n, _ in matches] == [(e, longest[e]) for e in ends]
        assert sorted(phrases_found) == sorted((i, label) for p, label in named.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p)
        for e, n, state in matches:
            assert sorted(auto.places(state)) == sorted((k, j) for k, t in enumerate(texts) for j in range(n, len(t) + 1) if t[j - n : j] == words[e - n : e])


def best_chain(anchors, gap):
    """The most words that a chain covers, by trying all."""

    def go(j):
        end, at, n = anchors[j]
        return max([n] + [go(p) + min(n, end - e, at - a) for p, (e, a, _) in enumerate(anchors) if 0 < min(n, end - e, at - a) and end - n - e <= gap and at - n - a <= gap])

    return max(map(go, range(len(anchors))))


def test_chains():
    rng = random.Random(4)
    for _ in range(100):
        anchors = sorted({(rng.randrange(5, 40), rng.randrange(5, 40), rng.randrange(1, 5)) for _ in range(9)})
        got = licences.chains(anchors, 6)
        assert got[0][2] == best_chain(anchors, 6) and all(first < last for first, last, _ in got)


def test_licence_spans(spark):
    rng = random.Random(5)
    filler = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    whole = licences.TEMPLATES["bsd"][0].split()
    edited = " ".join(w if i % 17 else "changed" for i, w in enumerate(whole))
    rows = [(1, f"{filler(50)} {' '.join(whole)} {filler(20)}"), (2, f"{filler(10)}\n{edited}"), (3, " ".join(whole[:20])), (4, filler(300)), (5, "x Licensed under CC BY-NC 4.0. y"), (6, "the terms of the software and of the license are in the file"), (7, "Licensed under the Apache License, Version 2.0."), (8, " ".join([*whole, "and"] * 400))]
    got = {r["doc_id"]: r for r in licences.licence_scan(make(spark, [(i, t, "en", "s", 1) for i, t in rows])).collect()}
    assert [got[i]["labels"] for i in range(1, 8)] == ["bsd", "bsd", "", "", "cc-by-nc", "", "apache"]
    first = next(s for s in got[1]["spans"] if s["share"] == 1)
    assert (first["first"], first["last"] - first["first"]) == (50, len(licences.licence_words(licences.TEMPLATES["bsd"][0]))) and got[1]["score"] == 1.0
    assert 0.75 <= got[2]["score"] < 1 and got[4]["score"] == 0 and got[7]["base_labels"] == "apache"
    assert sum(s["share"] == 1 for s in got[8]["spans"]) >= 400  # a long text, every copy found
    mine = licences.licence_scan(make(spark, [(1, "my own grant of all my rights", "en", "s", 1)]), {"own": ["My own grant of all rights"]}, {}).first()
    assert (mine["labels"], mine["n_base"], mine["score"]) == ("own", 0, 5 / 6)


def phrase_rows(docs, least, longest, top):
    """The contract, counted in Python."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    cands = {x: c for x, c in f.items() if len(x[1]) > 1 and c >= least}
    inside = collections.Counter()
    for (lang, p), c in cands.items():
        for z in range(2, len(p)):
            for i in range(len(p) - z + 1):
                inside[lang, p[i : i + z]] = max(inside[lang, p[i : i + z]], c)
    out = collections.defaultdict(list)
    for (lang, p), a in cands.items():
        if 100 * inside[lang, p] < 100 * a:
            s, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-s, -a, " ".join(p).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def mined(df, **kw):
    return sorted(tuple(r) for r in phrases.collocations(df, **kw).collect())


def test_phrases(spark, sample, odd, none):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)] + ["É", "\x00", "a\x00b", "　"]
    texts = []
    for i in range(120):
        t = rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=60)
        t[5:5] = ["New", "york", "city", "Marathon", "day"][: rng.randrange(2, 6)]
        texts.append((rng.choice(["en", "de", None, "", "und"]), "".join(w + rng.choice([" ", "  ", "\t", ". ", "\n", ",", " "]) for w in t)))
    texts += [("en", "ha " * 500), ("en", ". , ;"), ("en", None), ("xx", ""), ("en", "hot hot spot " * 90)] + [("en", "this very copy is here")] * 60
    df = make(spark, [(i, t, lang, "s", 1) for i, (lang, t) in enumerate(texts)])
    assert mined(df, least=12, longest=5, top=40, shards=3) == phrase_rows(texts, 12, 5, 40)
    assert mined(df, least=12, longest=3, top=40, shards=2, slots=64) == phrase_rows(texts, 12, 3, 40)  # nearly every slot is shared
    assert mined(none) == [] and mined(odd, least=10**6, longest=2, shards=1) == []
    assert mined(odd, least=20, shards=1) == phrase_rows([(r["lang"], r["text"]) for r in odd.collect()], 20, 5, 2000)


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(phrases, "ROW", 50)  # in this process only; tasks have their own
    run = phrases._tokenised(2, "")
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": lambda self: 0})()))
    text = "a b c d e. " * 40 + "x " * 200 + ". " + "f g. " * 30
    rows = [r for b in run(iter([pa.record_batch({"lang": ["en"], "text": [text]})])) for r in b.to_pylist()]
    sizes = [np.frombuffer(r["tokens"], np.uint64) for r in rows]
    assert all(s[-1] == 0 for s in sizes) and len(rows) > 5 and sum(r["n"] for r in rows) == 40 * 5 + 200 + 60
    assert max(len(s) for s in sizes) == 201 and {r["shard"] for r in rows} == {0, 1}


def test_a_slot_written_early_does_not_cut_a_count():
    """Both halves of ``a b c`` lie in slots that other phrases wrote in step 2; its words are active from step 5 on."""
    h = np.array([11, 22, 33, 0], np.uint64)
    one = phrases.mix(h[:3] ^ phrases._seed("en"))
    two = phrases._longer(one[:2], h[1:3])
    table = np.zeros((4, 1024), np.uint8)
    table[0, (one & np.uint64(1023)).astype(int)] = 5
    table[1, (two & np.uint64(1023)).astype(int)] = 2
    batch = pa.record_batch({"lang": ["en"], "tokens": pa.array([h.tobytes()], pa.binary())})
    steps = {}
    for step in range(1, 12):
        known = type("Sent", (), {"value": np.where(table <= step, table, 0)})  # what was written by then
        for b in phrases._counted(known, step, 3, 5, 1)(iter([batch])):
            for r in b.to_pylist():
                if r["n"] == 3:
                    steps[step] = np.frombuffer(r["since"], np.uint16).tolist()
    assert steps == {5: [5], 6: [5], 7: [5]}  # one cycle, every shard once


def test_counts_travel_in_small_batches():
    """However many phrases are active, what a task sends at once is bounded, and so are the ranges of long phrases."""
    rng = np.random.default_rng(3)
    h = np.append(rng.integers(1, 2**63, 200_000).astype(np.uint64), np.uint64(0))
    known = type("Sent", (), {"value": np.ones((4, 1024), np.uint8)})  # all are active since step 1
    sent = [b for b in phrases._counted(known, 1, 3, 5, 8)(iter([pa.record_batch({"lang": ["en"], "tokens": pa.array([h.tobytes()], pa.binary())})]))]
    assert max(b.nbytes for b in sent) < 2_000_000
    rows = [r for b in sent for r in b.to_pylist()]
    assert max(len(r["words"]) for r in rows) <= 8 * phrases.ROW
    for n in range(1, 6):
        own = [r for r in rows if r["n"] == n]
        assert {r["bucket"] for r in own} == set(range(8))
        assert sum(int(np.frombuffer(r["count"], np.int64).sum()) for r in own) == 200_001 - n
    for step, column in ((1, "words"), (3, "over_words")):  # phrases that go on, and those whose cycle is over
        got = phrases._added(known, step, 3, 5, 1)(pa.Table.from_pylist([r for r in rows if r["n"] == 5], schema=phrases._FOUND))
        assert sum(map(len, got[column].to_pylist())) == 40 * 199_996
        assert max(b.nbytes for b in got.to_batches()) < 2_000_000 and max(map(len, got[column].to_pylist())) <= 8 * phrases.ROW
