"""The pipeline stage by stage."""

import collections
import importlib

import corpus_pipeline
from auditlake.llm import queries as Q
from auditlake.llm.common import shingles

from .conftest import make
from .test_documents import components


def test_stages(spark, sample):
    docs = sample
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, "").persist()
        kept[name] = docs
        if name != names[-1]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    language, near, secret, mixed, packed = (kept[n].collect() for n in names)
    texts = {r["doc_id"]: r["text"] for r in sample.collect()}
    assert {r["doc_id"] for r in language} == {k for k, t in texts.items() if t and any(c.isalpha() for c in t)}
    comp = components({r["doc_id"]: shingles(r["text"]) for r in language})
    assert collections.Counter(r["doc_id"] for r in near) == collections.Counter({k: 1 for k, c in comp.items() if k == c})
    assert len(secret) == len(near) and sum(r["text"] != texts[r["doc_id"]] for r in secret) == sum("[SECRET]" in r["text"] for r in secret)
    count = collections.Counter(r["doc_id"] for r in mixed)
    assert set(count) <= {r["doc_id"] for r in secret} and max(count.values()) <= 3
    pieces = collections.defaultdict(int)
    for r in packed:
        pieces[r["doc_id"]] += r["length"]
    sizes = {r["doc_id"]: r["doc_tokens"] for r in packed}
    assert {k: v * sizes[k] for k, v in count.items()} == pieces


def test_run_is_its_stages_one_after_the_other(spark, sample):
    docs = sample
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "").persist()
    key = lambda rows: collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    tokens = lambda rows: sum(r["length"] for r in rows)
    got, want = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect(), docs.collect()
    assert {k[0] for k in key(got)} == {k[0] for k in key(want)} and tokens(got) == tokens(want)


def test_one_of_two_texts_of_an_id_is_a_copy(spark):
    texts = [" ".join(f"{c}{i}" for i in range(40)) for c in "ab"]
    rows = [(3, texts[0], "en", "s", 1), (5, texts[0], "en", "s", 1), (5, texts[1], "en", "s", 1), (9, texts[1], "en", "s", 1)]
    got = corpus_pipeline.near_copies(spark, make(spark, rows), "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(3, texts[0]), (5, texts[1])]


def test_odd_rows_and_no_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, "").persist()
            docs.count()


def test_queries_are_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in Q.queries() if k.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in Q.queries()
    entry = importlib.import_module("__spark_entry__")
    assert set(Q.queries()) <= set(entry.queries())
