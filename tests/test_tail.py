"""Files that grow, many words, counters of one pass, reports."""

import io

import pytest
from pyspark.sql import functions as F

from auditlake.operators import filters
from auditlake.plans import jobs, reports
from auditlake.streaming.logs import run_to_table
from auditlake.streaming.tail import lines_of, tail_lines
from tests.test_records import line, parsed


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_blocks_share_out_the_lines(block):
    text = b"one\n\ntwo\r\na long line\n\nx\n"
    whole = [r for i in range(0, len(text), block) for r in lines_of(io.BytesIO(text), i, min(i + block, len(text)), i == 0)]
    assert [r for _, r in whole] == text[:-1].split(b"\n")
    assert all(text[at : at + len(r) + 1] == r + b"\n" for at, r in whole)
    later = [r for i in range(5, len(text), block) for _, r in lines_of(io.BytesIO(text), i, min(i + block, len(text)), i == 5)]
    assert later == text[5:-1].split(b"\n")


def test_lines_arrive_once_over_restarts(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()

    def arrived():
        rows = run_to_table(tail_lines(spark, str(folder), 7), f"{tmp_path}/out", f"{tmp_path}/state")
        return sorted((r["file"], r["pos"], r["value"]) for r in rows.collect())

    first = [("a.log", 0, "one"), ("a.log", 4, "two")]
    (folder / "a.log").write_text("one\ntwo\nthr")
    (folder / "c.txt").write_text("no log\n")
    assert arrived() == first
    with (folder / "a.log").open("a") as f:
        f.write("ee\n")
    (folder / "b.log").write_text("x\n")
    second = sorted([*first, ("a.log", 8, "three"), ("b.log", 0, "x")])
    assert arrived() == second
    (folder / "a.log").write_text("new head\ntwo\nthree\nfour\n")  # longer than before, and another file
    (folder / "b.log").unlink()
    third = sorted([*second, ("a.log", 0, "new head"), ("a.log", 9, "two"), ("a.log", 13, "three"), ("a.log", 19, "four")])
    assert arrived() == third
    (folder / "a.log").write_text("new\n")  # shorter
    assert arrived() == sorted([*third, ("a.log", 0, "new")])


def test_counters_of_one_pass(spark, tmp_path):
    rows = [line(user=f"U{i % 3}", trx=str(i)) for i in range(30)] + ["junk", "", line(body="PARAMS(SEQNO, TYPE, DATA)={}")]
    read = parsed(spark, rows)
    for n, options in enumerate(({}, {"patterns": {"username": ["U1"]}}, {"patterns": {"username": ["none"]}, "bind": False}, {"transactions": filters.indicators(min_ms=1e9)}, {"transactions": filters.indicators(min_ms=1), "limit": 4})):
        got = jobs.export_counted(read, lambda df, n=n: df.write.parquet(f"{tmp_path}/{n}"), **options)
        assert got == jobs.export_counts(read, jobs.export_job(read, **options)).first().asDict()
        assert spark.read.parquet(f"{tmp_path}/{n}").count() == got["exported"]


def test_reports(spark):
    read = parsed(spark, [line(body=f"[SEL] SELECT {c}{i % 2} FROM t") for i in range(5) for c in "abc"] + ["junk"])
    report = reports.digest_report(read, top=2)
    assert report["summary"].first().asDict() == {"files": 1, "records": 15, "errors": 1, "skipped": 0, "fingerprints": 6, "shown": 2}
    lines = [r["value"] for r in reports.json_lines(report).collect()]
    assert len(lines) == 3 and all(x.startswith('{"section":') for x in lines)
    listing = spark.createDataFrame([("a.log", 5), ("empty.log", 0)], "file string, size long")
    stats = reports.stats_report(read, listing, groups=["user"], bucket="hour")
    assert [*stats] == ["summary", "per_file", "slow", "groups", "buckets"]
    assert {(r["file"], r["records"], r["errors"]) for r in stats["per_file"].collect()} == {("a.log", 15, 1), ("empty.log", 0, 0)}
    assert reports.json_lines(stats).filter(F.col("value").contains('"section":"per_file"')).count() == 2
