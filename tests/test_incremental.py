"""The manifest, its commits, and results kept per file."""

import os

import pytest

from auditlake.operators import partials, stats, templates
from auditlake.plans import jobs
from auditlake.sources.manifest import SCHEMA, Conflict, Incremental, Manifest

from .test_records import line


def write(folder, name, lines, at):
    (folder / name).write_text("".join(x + "\n" for x in lines))
    os.utime(folder / name, (at, at))


def rows(df):
    return sorted(map(str, df.collect()))


def same_as_full(spark, logs, kept):
    """Results from parts against a run over all files."""
    full = jobs.load(spark, str(logs)).filter("parse_ok")
    cols = ["fingerprint", "count", "total_ms", "max_ms", "example", "first_seen"]
    assert rows(partials.digest_of(kept.read("digest")).select(*cols)) == rows(stats.digest(full).select(*cols))
    assert rows(templates.template_stats(templates.merged([kept.read("template").drop("path")]))) == rows(templates.template_stats(templates.observed(full)))
    for by in ("hour", "minute"):
        assert rows(partials.buckets_of(kept.read("minute"), by)) == rows(stats.buckets(full, by))


def test_results_stay_right_as_files_come_change_and_go(spark, tmp_path):
    logs = tmp_path / "logs dir+x"
    logs.mkdir()
    body = "[SEL] SELECT {} FROM t{}. EXECTIME: {}(ms) ROWCOUNT: 1(rows) EXEC_ID: 1."
    for k in range(4):
        write(logs, f"{k}.log", [line(s=i, trx=str(10 * k + i), body=body.format(i, k % 2, i + k)) for i in range(5)] + ["junk"], 1000 + k)
    kept = Incremental(spark, str(logs), str(tmp_path / "kept"), partials.PARTS)
    assert kept.update() == {"read": 4, "skipped": 0, "removed": 0, "version": 1}
    same_as_full(spark, logs, kept)
    assert kept.update() == {"read": 0, "skipped": 4, "removed": 0, "version": 1}
    write(logs, "1.log", [line(s=9, body=body.format(9, 9, 9))], 1001)  # another size
    write(logs, "2.log", [line(s=i, trx=str(20 + i), body=body.format(7, 0, i)) for i in range(5)] + ["junk"], 2000)  # another time
    write(logs, "new.log", [line(s=3, body=body.format(1, 5, 2))], 3000)
    os.remove(logs / "3.log")
    seen = []
    assert kept.update(lambda r: seen.extend(x["file"] for x in r.select("file").distinct().collect())) == {"read": 3, "skipped": 1, "removed": 1, "version": 2}
    assert sorted(seen) == ["1.log", "2.log", "new.log"]  # nothing else was read
    same_as_full(spark, logs, kept)
    assert {r["path"].rsplit("/", 1)[1]: r["records"] for r in kept.manifest.read().collect()} == {"0.log": 5, "1.log": 1, "2.log": 5, "new.log": 1}
    assert kept.manifest.read(1).count() == 4  # older versions can be read


def test_nothing_is_committed_when_a_job_dies(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write(logs, "a.log", [line()], 1)
    kept = Incremental(spark, str(logs), str(tmp_path / "kept"), {"digest": partials.digest_part})

    def fails(records):
        raise OSError("lost")

    with pytest.raises(OSError, match="lost"):
        kept.update(fails)
    assert kept.manifest.version() == 0 and kept.manifest.read().count() == 0
    with pytest.raises(ValueError):
        kept.read("digest")
    broken = Incremental(spark, str(logs), str(tmp_path / "kept"), {"digest": partials.digest_part, "late": fails})
    with pytest.raises(OSError):  # parts were written, but no manifest names them
        broken.update()
    assert kept.update()["read"] == 1 and kept.update()["read"] == 0 and partials.digest_of(kept.read("digest")).first()["count"] == 1


def test_jobs_read_and_commit_the_manifest(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    write(logs, "a.log", [line(s=1), line(s=2)], 1)
    kept, out = Incremental(spark, str(logs), str(tmp_path / "kept"), partials.PARTS), []
    export = lambda: jobs.export_new(kept, lambda rows: out.append(rows.count()), fields=["ts", "sql"])["read"]
    assert (export(), export()) == (1, 0)
    write(logs, "b.log", [line(s=3)], 2)
    assert export() == 1 and out == [2, 1]
    assert [(r["count"], r["rank"]) for r in jobs.digest_kept(kept).collect()] == [(3, 1)]
    got = jobs.stats_kept(kept)
    assert sum(r["records"] for r in got["files"].collect()) == 3 and [b["count"] for b in got["buckets"].collect()] == [3]


def test_two_writers(spark, tmp_path):
    store = Manifest(spark, str(tmp_path))
    row = lambda p: spark.createDataFrame([(p, 1, 1, 1, None, "b")], SCHEMA)
    calls = []

    def slow(manifest):
        calls.append(manifest.count())
        if len(calls) == 1:  # another writer commits in between
            Manifest(spark, str(tmp_path)).commit(lambda m: m.unionByName(row("other")))
        return manifest.unionByName(row("mine"))

    assert store.commit(slow) == 2 and calls == [0, 1]
    assert sorted(r["path"] for r in store.read().collect()) == ["mine", "other"]
    assert not [f for f in os.listdir(tmp_path) if f.startswith("_new")]

    def always(manifest):
        Manifest(spark, str(tmp_path)).commit(lambda m: m)
        return manifest

    with pytest.raises(Conflict):
        store.commit(always, tries=2)


def test_files_are_skipped_by_time_and_transaction(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    head = "2025-0{m}-{d:02d} 10:00:00.000 (EP[0] sess:0x1 thrd:1 user:U trxid:{t} stmt:0x1 appname:A ip:1) [SEL] SELECT 1"
    for m in range(1, 9):
        write(logs, f"{m}.log", [head.format(m=m, d=d, t=100 * m + d) for d in range(1, 28)], m)
    kept = Incremental(spark, str(logs), str(tmp_path / "kept"), {"zone": partials.zone_part})
    kept.update()
    names = lambda **kw: sorted(r["path"].rsplit("/", 1)[1] for r in partials.files_with(kept.read("zone"), **kw).collect())
    assert names(start="2025-03-02", end="2025-04") == ["3.log", "4.log"] and names(start="2026") == []
    assert "5.log" in names(trx_ids=["505"]) and len(names(trx_ids=["505"])) <= 2 and names(trx_ids=[]) == []
    assert names(start="2025-06", trx_ids=["505"]) == [] or "5.log" not in names(start="2025-06", trx_ids=["505"])
    full = jobs.load(spark, str(logs))
    got = kept.records("2025-03-02", "2025-04-01")
    assert len({f for f in got.inputFiles()}) == 2 and got.count() == full.filter("ts >= '2025-03-02' AND ts < '2025-04-02'").count()
    one = kept.records(trx_ids=["505", "nowhere"])
    assert one.count() == 1 and len(one.inputFiles()) <= 2
    write(logs, "late.log", [head.format(m=5, d=28, t=505)], 99)  # not in the manifest yet
    assert kept.records(trx_ids=["505"]).count() == 2 and kept.records(start="2027").count() == 0


def test_text_is_parsed_once_for_all_parts(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    write(tmp_path / "logs", "a.log", [line()], 1000)
    given = []
    kept = Incremental(spark, str(tmp_path / "logs"), str(tmp_path / "kept"), {"x": lambda r: (given.extend(r.inputFiles()), r.select("path", "sql"))[1]})
    assert kept.update()["read"] == 1 and kept.read("x").first()["sql"] == "SELECT 1"
    assert given and all(f.endswith(".parquet") for f in given) and not [*(tmp_path / "kept" / "_parsed").glob("*-*")] and not [*(tmp_path / "kept" / "_parsed").iterdir()]
