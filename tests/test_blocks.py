"""Records over block ends, and binding over slices."""

import io
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from auditlake import fixtures
from auditlake.functions import text as X
from auditlake.operators import binding, filters, shaping, stats, templates
from auditlake.plans import jobs
from auditlake.sources import blocks, logs, sinks
from auditlake.streaming import tail

from .test_records import line, parsed


def assembled(text):
    """Records of a file, line by line."""
    lines, out = text.split("\n"), []
    if lines[-1] == "":
        lines.pop()
    started = False
    for x in lines:
        if blocks._HEADER.match(b"\n" + x.encode(), 1):
            started = True
            out.append(x)
        elif started:
            out[-1] += "\n" + x
        else:
            out.append(x)
    return out


def test_every_cut_of_a_file_gives_the_same_records(monkeypatch):
    rng = random.Random(2)
    for trial in range(60):
        parts = [rng.choice([line(s=i % 60), line(body="[SEL] SELECT a\nFROM t\n\n WHERE x"), "no header", "", "2025-01-15 10:00:00.000 (EP", line(body="y" * 300)]) for i in range(rng.randrange(1, 14))]
        text = "\n".join(parts) + rng.choice(["", "\n", "\n\n"])
        raw = text.encode()
        monkeypatch.setattr(blocks, "_READ", rng.choice([7, 64, 1000]))
        for size in (1, 5, 90, 333, 10_000) if trial % 10 == 0 else (90, 333):
            found = [r for i in range(0, len(raw), size) for r in blocks.records_of(io.BytesIO(raw), i, min(i + size, len(raw)))]
            assert [x.decode().removesuffix("\n") for _, x in found] == assembled(text)
            assert [raw[a : a + len(x)] for a, x in found] == [x for _, x in found]


def test_blocks_in_spark(spark, tmp_path):
    rows = [line(s=i % 60, trx=str(i), body="[SEL] SELECT a\nFROM t" + "\nAND b" * (i % 40) + ". EXECTIME: 1(ms) ROWCOUNT: 1(rows) EXEC_ID: 1.") for i in range(300)]
    (tmp_path / "a b+c.log").write_text("junk\nmore\n" + "\n".join(rows) + "\n")
    (tmp_path / "g.log").write_bytes("\r\n".join([line(body="[SEL] SELECT '张三'\n1"), line()]).replace("\n1", "\r\n1").encode("gb18030"))
    (tmp_path / "empty.log").write_text("")
    (tmp_path / "other.txt").write_text(line())
    got = blocks.read_records(spark, str(tmp_path), 5000, "gb18030")
    assert got.filter("file = 'a b+c.log'").select(F.spark_partition_id().alias("p")).distinct().count() > 10
    by = {f: [r["value"] for r in got.filter(F.col("file") == f).orderBy("pos").collect()] for f in ("a b+c.log", "g.log", "other.txt")}
    assert by["a b+c.log"] == ["junk", "more", *rows] and by["other.txt"] == [] and by["g.log"][0].endswith("'张三'\n1") and len(by["g.log"]) == 2
    assert blocks.read_records(spark, f"file:{tmp_path}/g.log").count() == 2 and blocks.read_records(spark, f"{tmp_path}/*.txt").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        blocks.read_records(spark, f"{tmp_path}/none").count()
    full = jobs.load(spark, str(tmp_path), multiline=True).filter("parse_ok").select("file", "trx_id", "sql")
    by_sort = logs.parse_sqllog(logs.assemble(logs.scan_logs(spark, str(tmp_path)))).filter("parse_ok AND file <> 'g.log'").select("file", "trx_id", "sql")
    assert sorted(map(str, full.filter("file <> 'g.log'").drop("file").collect())) == sorted(map(str, by_sort.drop("file").collect()))


def bound_in_python(rows):
    last, out = {}, []
    for _, sess, sql, given in rows:
        if given is not None:
            last[sess] = given
        out.append(last.get(sess) if given is None else None)
    return out


def test_a_busy_session_is_bound_in_slices(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 9 + ["cold"]), "", f"{i}" if rng.random() < 0.002 else None) for i in range(6000)]
    df = spark.createDataFrame([(f, p, s, "h", None if g else "UPD", f"PARAMS(SEQNO, TYPE, DATA)={{(0, INT, {g})}}" if g else "UPDATE t SET a = ?") for f, (p, s, _, g) in (("f", r) for r in rows)], "file string, pos long, sess_id string, statement string, tag string, sql string")
    want = [None if v is None else f"UPDATE t SET a = {v}" for v in bound_in_python(rows)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for width in (1, 50, 700, 10**9):
            assert [r["normalized_sql"] for r in binding.bind_params(df, width=width).orderBy("pos").collect()] == want
        sizes = [r["n"] for r in binding.bind_params(df, width=100).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) >= 4 and max(sizes) < 0.5 * len(rows)  # nine tenths of the rows are one session
    blocked = df.withColumn("pos", F.struct(F.floor(F.col("pos") / 500).alias("block"), F.col("pos").alias("row")))
    assert [r["normalized_sql"] for r in binding.bind_params(blocked).orderBy("pos").collect()] == want


def test_ordinals_of_any_length(spark):
    one = spark.createDataFrame([(":12345678901",), ("a::5",), (":2 ? ':9'",), ("x::text",), (":0",), (":" + "9" * 25,)], "s string").select("s", X.placeholders(F.col("s")).alias("p"), X.bind(F.col("s"), F.array(F.lit("A"), F.lit("B")), F.lit(True)).alias("b"))
    got = [(r["p"]["n"], r["p"]["ordinal"], r["b"]) for r in one.collect()]
    assert got == [(12345678901, True, ":12345678901"), (5, True, "a::5"), (2, True, "B ? ':9'"), (0, False, "x::text"), (0, False, "A"), (2**63 - 1, True, ":" + "9" * 25)]


def test_a_user_called_others(spark):
    users = spark.createDataFrame([("a", 9), ("Others", 5), ("b", 1)], "username string, count long")
    assert sorted((r["slice"], r["count"], r["rest"]) for r in templates.user_share(users, 2).collect()) == [("Others", 1, True), ("Others", 5, False), ("a", 9, False)]


def test_all_patterns_are_checked_first(spark):
    r = parsed(spark, [line()])
    for kw in ({"patterns": {"username": ["("]}}, {"unwanted": {"appname": ["a", "["]}}, {"sql_patterns": ((), ("*",))}, {"unwanted": {"nosuch": []}}):
        with pytest.raises(ValueError):
            jobs.export_job(r, **kw)
    assert jobs.export_job(r, patterns={"username": ["U"]}, unwanted={"appname": ["B"]}, sql_patterns=(["SELECT"], ["DELETE"])).count() == 1
    assert jobs.export_job(r, unwanted={"appname": ["A"]}).count() == 0 and jobs.export_job(r, sql_patterns=((), ["SELECT"])).count() == 0
    with pytest.raises(ValueError):
        filters.check_patterns(spark, {"username": ["("]})


def test_lost_and_skipped_files_in_the_statistics_job(spark):
    r = parsed(spark, [line(), "junk"])
    listing = spark.createDataFrame([("a.log", 5), ("lost.log", 7), ("empty.log", 0)], "file string, size long")
    got = jobs.stats_job(r, listing=listing, skipped=listing.filter("file = 'empty.log'"))["totals"]
    assert got.first().asDict() == {"files": 1, "records": 1, "errors": 2, "skipped": 1}
    assert stats.totals(r.limit(0)).first().asDict() == {"files": 0, "records": 0, "errors": 0, "skipped": 0}


def test_ranks_over_many_ranges(spark):
    df = spark.range(5000).selectExpr("cast(hash(id) AS long) * 7 + id AS x", "'a' AS y").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = shaping.with_rank(df, F.desc("x"))
        got = ranked.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    xs = sorted((r["x"] for r in df.collect()), reverse=True)
    assert sorted((r["rank"], r["x"]) for r in got) == list(zip(range(1, 5001), xs, strict=True))
    assert len(ranked.inputFiles()) > 2 and ranked.columns == ["x", "y", "rank"]
    assert shaping.with_rank(df.limit(0), "x").count() == 0


def test_a_failed_export_leaves_no_rows(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = spark.range(2000).repartition(4).withColumn("x", F.expr("IF(id = 1777, raise_error('lost'), 'y')"))
    with pytest.raises(Exception, match="lost"):
        sinks.write_csv(bad, path)
    left = [p for p in tmp_path.rglob("part-*") if "_temporary" not in str(p)]
    assert left == [] and not (tmp_path / "out" / "_SUCCESS").exists()


def test_small_blocks_of_much_text_are_few_tasks(tmp_path):
    (tmp_path / "a.log").write_text((line() + "\n") * 20_000)
    (tmp_path / "b.log").write_text(line() + "\n")
    parts = blocks._Reader({"path": str(tmp_path), "blockbytes": "200"}).partitions()
    assert blocks.TASKS // 2 < len(parts) <= blocks.TASKS + 2 and blocks.width(1 << 17, 1 << 40) == blocks.MOST
    reader = tail.TailReader({"path": str(tmp_path), "blockbytes": "200"})
    assert len(reader.partitions({"files": {}}, reader.latestOffset())) <= blocks.TASKS + 2
    found = [at for p in parts for at, _ in blocks.records_of((tmp_path / p.path.rpartition("/")[2]).open("rb"), p.start, p.end)]
    assert len(found) == 20_001


def test_a_log_file_is_written_in_parts(spark, monkeypatch):
    given = []
    real = fixtures.join_files
    monkeypatch.setattr(fixtures, "join_files", lambda spark, joined: (given.extend(joined), real(spark, joined)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = fixtures.write_log_files(spark, "/root/testdata/sf0.001", lambda lines: lines.filter("file = 'orders_1995.log'"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(given) == 1 and len(given[0][0]) > 1
    want = fixtures.log_lines(spark, "/root/testdata/sf0.001").filter("file = 'orders_1995.log'").orderBy("pos").select("value").collect()
    assert Path(folder.removeprefix("file:"), "orders_1995.log").read_text().splitlines() == [r["value"] for r in want]
