"""Files, parsing, filters, binding, statistics and sinks on small logs."""

import re
import time

import pytest
from pyspark.sql import functions as F

from auditlake.operators import binding, filters, shaping, stats, templates
from auditlake.plans import jobs
from auditlake.sources import logs, sinks
from auditlake.streaming import logs as streams

HEAD = "2025-01-15 10:00:{s:02d}.000 (EP[0] sess:0x{sess} thrd:1 user:{user} trxid:{trx} stmt:0x1 appname:{app} ip:10.0.0.1) "


def line(s=0, sess="1", user="U", trx="1", app="A", body="[SEL] SELECT 1. EXECTIME: 5(ms) ROWCOUNT: 2(rows) EXEC_ID: 3."):
    return HEAD.format(s=s, sess=sess, user=user, trx=trx, app=app) + body


def parsed(spark, lines, file="a.log"):
    return logs.parse_sqllog(spark.createDataFrame([(file, i, v) for i, v in enumerate(lines)], "file string, pos long, value string"))


def test_parse(spark):
    rows = parsed(spark, [line(), line(app="My App"), line(body="PARAMS(SEQNO, TYPE, DATA)={}"), "junk", "", None]).orderBy("pos").collect()
    assert [r["parse_ok"] for r in rows] == [True, True, True, False, False, False]
    assert (rows[0]["sql"], rows[0]["exec_time_ms"], rows[0]["row_count"], rows[0]["exec_id"], rows[0]["tag"]) == ("SELECT 1", 5.0, 2, 3, "SEL")
    assert rows[1]["appname"] == "My App" and rows[2]["tag"] is None and rows[2]["exec_time_ms"] is None and rows[3]["sql"] is None


def test_scan_assemble_and_list(spark, tmp_path):
    (tmp_path / "b.log").write_text(line(1) + "\n")
    (tmp_path / "a.log").write_text("lost\n" + line(2, body="[SEL] SELECT a\nFROM t\n. EXECTIME: 1(ms) ROWCOUNT: 1(rows) EXEC_ID: 1.") + "\n" + line(3) + "\n")
    (tmp_path / "c.txt").write_text(line(4) + "\n")
    (tmp_path / "empty.log").write_text("")
    got = jobs.load(spark, str(tmp_path), multiline=True).orderBy("file", "pos").collect()
    assert [(r["file"], r["parse_ok"]) for r in got] == [("a.log", False), ("a.log", True), ("a.log", True), ("b.log", True)]
    assert got[1]["sql"] == "SELECT a\nFROM t\n" and got[1]["exec_time_ms"] == 1
    assert logs.scan_logs(spark, str(tmp_path / "c.txt")).count() == 1
    assert logs.scan_logs(spark, str(tmp_path / "*")).count() == 6
    assert sorted(r["file"] for r in logs.list_logs(spark, str(tmp_path)).collect()) == ["a.log", "b.log", "empty.log"]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        logs.scan_logs(spark, str(tmp_path / "none")).count()


def test_gb18030(spark, tmp_path):
    text = line(body="[SEL] SELECT '张三', \"x\\y\". EXECTIME: 1(ms) ROWCOUNT: 1(rows) EXEC_ID: 1.")
    lines = [text, "", "  ", text + "\u9f98"]
    (tmp_path / "a.logs").mkdir()
    one = tmp_path / "a.logs" / "g.log"
    one.write_bytes("\n".join(lines).encode("gb18030"))
    (tmp_path / "a.logs" / "other.txt").write_text("no log")
    for path in (one, tmp_path / "a.logs", f"{tmp_path}/a.logs/g*"):  # a folder may have a dot in its name
        assert [r["value"] for r in logs.decode_gb18030(spark, str(path)).orderBy("pos").collect()] == lines
        assert logs.scan_logs(spark, str(path)).count() == 4


def test_unreadable_and_skipped_files_are_counted(spark, tmp_path):
    (tmp_path / "a.log").write_text(line() + "\n")
    (tmp_path / "empty.log").write_text("")
    listing = logs.list_logs(spark, str(tmp_path)).unionByName(spark.createDataFrame([("gone.log", "/gone.log", 9, 1)], "file string, path string, size long, mtime long"))
    read = logs.parse_sqllog(logs.scan_logs(spark, str(tmp_path), tolerant=True))
    assert stats.totals(read, listing, listing.filter("file = 'empty.log'")).first().asDict() == {"files": 1, "records": 1, "errors": 1, "skipped": 1}


def test_manifest(spark):
    listing = spark.createDataFrame([("a", "/a", 1, 1), ("b", "/b", 2, 2), ("c", "/c", 3, 3)], "file string, path string, size long, mtime long")
    manifest = spark.createDataFrame([("a", "/a", 1, 1), ("b", "/b", 9, 2)], listing.schema)
    assert [r["file"] for r in logs.new_files(listing, manifest).orderBy("file").collect()] == ["b", "c"]
    after = logs.mark_done(manifest, logs.new_files(listing, manifest))
    assert logs.new_files(listing, after).count() == 0 and after.count() == 3


def test_filters(spark):
    r = parsed(spark, [line(1, user="ALICE", trx="1"), line(2, user="bob", trx="2"), line(3, user="carol", trx="2", body="PARAMS(SEQNO, TYPE, DATA)={}")])
    keep = lambda c: sorted(x["username"] for x in r.filter(c).collect())
    assert keep(filters.include({"username": ["^A", "bo"]})) == ["ALICE", "bob"]
    assert keep(filters.include({"username": [], "appname": ["A"]})) == ["ALICE", "bob", "carol"]
    assert keep(filters.exclude({"username": ["^A"], "client_ip": ["11"]})) == ["bob", "carol"]
    assert keep(filters.tags(["SEL"])) == ["ALICE", "bob"] and keep(filters.tags(unwanted=["SEL"])) == ["carol"]
    assert keep(filters.record_sql(["nothing"])) == ["carol"]
    assert keep(filters.time_range("2025-01-15 10:00:02", "2025-01-15")) == ["bob", "carol"]
    assert keep(filters.stats_any({"username": ["LIC"]}, ["2"])) == ["ALICE", "bob", "carol"] and keep(filters.stats_any({})) == ["ALICE", "bob", "carol"]
    assert keep(filters.indicators()) == [] and keep(filters.indicators(min_rows=2)) == ["ALICE", "bob"]
    assert sorted(x["username"] for x in filters.retain_transactions(r, F.col("username") == "bob").collect()) == ["bob", "carol"]
    assert filters.retain_transactions(r, F.lit(False)).count() == 0
    assert filters.pipeline(r, []).count() == 3 and filters.pipeline(r, [F.lit(False)], enabled=False).count() == 3
    with pytest.raises(ValueError, match="username"):
        filters.check_patterns(spark, {"username": ["("]})


def test_binding(spark):
    def given(x):
        return "PARAMS(SEQNO, TYPE, DATA)={(0, DEC, %s)}" % x

    use = "[UPD] UPDATE t SET a = ?"
    rows = [line(body=use), line(body=given(1)), line(body=use), line(body="PARAMS(broken"), line(body=use), line(body=given(2)), line(body=use), line(sess="2", body=use), line(body="[UPD] UPDATE t SET a = ?, b = ?"), line(body="[SEL] SELECT 1")]
    got = [r["normalized_sql"] for r in binding.bind_params(parsed(spark, rows)).orderBy("pos").collect()]
    assert got == [None, None, "UPDATE t SET a = 1", None, "UPDATE t SET a = 1", None, "UPDATE t SET a = 2", None, None, None]
    with pytest.raises(ValueError):
        binding.bind_params(parsed(spark, rows), "other")


def test_records_are_computed_once_for_binding(spark):
    use = "[UPD] UPDATE t SET a = ?"
    rows = parsed(spark, [line(body=b) for b in ("PARAMS(SEQNO, TYPE, DATA)={(0, DEC, 1)}", use, "[SEL] SELECT 1", use)])
    seen = spark.sparkContext.accumulator(0)

    def count(sql):
        seen.add(1)
        return sql

    counted = rows.withColumn("sql", F.udf(count, "string")("sql"))
    got = [r["normalized_sql"] for r in binding.bind_params(counted).orderBy("pos").collect()]
    assert got == [None, "UPDATE t SET a = 1", None, "UPDATE t SET a = 1"] and seen.value == 4


def test_percentiles(spark):
    seen = spark.createDataFrame([("k", i, 1, "a", "b") for i in range(1, 101)], "template_key string, us long, n long, first_seen string, last_seen string")
    for mode in ("exact", "hdr"):
        r = templates.template_stats(seen, mode).first()
        assert (r["count"], r["min_us"], r["max_us"], r["p50_us"], r["p95_us"], r["p99_us"], r["avg_us"]) == (100, 1, 100, 50, 95, 99, 50)


def test_chart_data(spark):
    users = spark.createDataFrame([("a", 5), ("b", 3), ("c", 2)], "username string, count long")
    assert sorted((r["slice"], r["share"]) for r in templates.user_share(users, 2).collect()) == [("Others", 20.0), ("a", 50.0), ("b", 30.0)]
    assert sorted(r["slice"] for r in templates.user_share(users, 3).collect()) == ["a", "b", "c"]
    trend = lambda *h: [r["label"] for r in templates.trend_labels(spark.createDataFrame([(x, 1) for x in h], "hour string, count long")).orderBy("hour").collect()]
    assert trend("2025-01-15 09", "2025-01-15 10") == ["09:00", "10:00"] and trend("2025-01-15 09", "2025-01-16 10") == ["01-15 09:00", "01-16 10:00"]


def test_stats_and_jobs(spark):
    r = parsed(spark, [line(1, user=""), line(2, user="x", body="[SEL] SELECT 2"), line(3, user="x"), "junk"])
    got = {k: v.collect() for k, v in jobs.stats_job(r, groups=["user", "ip"], bucket="hour").items()}
    assert got["totals"][0].asDict() == {"files": 1, "records": 3, "errors": 1, "skipped": 0}
    assert sorted((g["section"], g["key"], g["count"], g["total_ms"]) for g in got["groups"]) == [("ip", "10.0.0.1", 3, 10.0), ("user", "(unknown)", 1, 5.0), ("user", "x", 2, 5.0)]
    assert [b["bar_len"] for b in got["buckets"]] == [20] and [s["rank"] for s in got["slow"]] == [1, 2]
    digest = jobs.digest_job(r).collect()
    assert [(d["fingerprint"], d["count"], d["rank"]) for d in digest] == [("SELECT ?", 3, 1)]
    with pytest.raises(ValueError):
        stats.group_by(r, "none")
    out = jobs.export_job(r, [filters.include({"username": ["x"]})], fields=["sql", "exec_id"], limit=1).collect()
    assert [tuple(x) for x in out] == [("SELECT 2", None)]
    with pytest.raises(ValueError):
        shaping.project(r, ["none"])
    assert jobs.transactions_of(r, min_ms=5).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", \n\'x\''), (2, None)], "a int, sql string")
    path = str(tmp_path / "out")
    sinks.write_csv(df, path)
    sinks.write_csv(df, path, append=True, overwrite=True)
    assert sorted(map(str, sinks.read_csv(spark, path, df.schema).collect())) == sorted(map(str, df.collect() * 2))
    assert sinks.dry_run(df) == {"exported": 2}
    sinks.write_templates(df, csv_path=f"{path}.csv")
    assert (tmp_path / "out_templates.csv").exists()
    taken = []
    sinks.export(df, sink=taken.append, csv_path="unused")
    assert taken == [df]
    with pytest.raises(ValueError):
        sinks.write_table(df, "a b")
    with pytest.raises(ValueError):
        sinks.export(df)


def test_complete_stream_is_a_table_of_files(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    line = "2025-01-15 10:00:0{}.000 (EP[0] sess:0x1 thrd:1 user:A trxid:1 stmt:0x1 appname:x ip:::1) SELECT {}\n"
    for round_ in (1, 2):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{round_}.log").write_text("".join(line.format(i, i) for i in range(5)))
        done = streams.run_to_table(streams.stream_records(spark, folder).groupBy("file").agg(F.count("*").alias("n")), out, state, "complete")
        assert done.inputFiles()
        assert {r["file"]: r["n"] for r in done.collect()} == {f"{i}.log": 5 for i in range(1, round_ + 1)}


def test_long_runs_of_blanks_are_parsed_alike(spark):
    tails = ["", " EXECTIME: 1.5(ms) ROWCOUNT: 2(rows) EXEC_ID: 3.", " . EXECTIME: 1(ms) ROWCOUNT: 2(rows) EXEC_ID: 3", "EXECTIME: 1(ms)", " \n"]
    rows = [(head + body.replace("_", blank) + tail) for head in ("[SEL] ", "") for body in ("", "_", "a_b", "a_", "_ f(x) _", "a]_.") for tail in tails for blank in (" ", " " * 30, " \n" * 20)]
    got = parsed(spark, [line(body=r) for r in rows]).orderBy("pos").collect()
    one = re.compile(logs.RECORD.replace(r"\z", r"\Z"), re.ASCII)
    assert [(r["tag"], r["sql"], r["exec_id"]) for r in got] == [(m[10], m[11], m[14] and int(m[14])) for m in (one.match(line(body=r)) for r in rows)]


def test_time_grows_with_blanks_and_not_with_their_square():
    for run in (" \n", " "):
        text = line(body="[SEL] " + ("a" + run * 20_000) * 3 + "b")
        begin = time.perf_counter()
        assert re.match(logs.BLANKS.replace(r"\z", r"\Z"), text)
        assert time.perf_counter() - begin < 2
