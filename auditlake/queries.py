"""Every operator as a query over the given tables, with the same answer in SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.fixtures import W_SQL, log_lines, records, write_log_files
from auditlake.functions import text as X
from auditlake.operators import binding, filters, partials, shaping, stats, templates
from auditlake.operators.partials import PARTS
from auditlake.plans import reports
from auditlake.plans.jobs import digest_job, export_counted, export_counts, export_job, export_new
from auditlake.sources import blocks, logs, sinks
from auditlake.sources.manifest import Incremental
from auditlake.storage import remove, shared_folder
from auditlake.streaming import logs as streams
from auditlake.streaming.tail import tail_lines

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = W_SQL + sql
        return f

    return add


def _r4(*names: str) -> list:
    return [F.round(n, 4).alias(n) for n in names]


_META = "ts, ep, sess_id, thrd_id, username, trx_id, statement, appname, client_ip, tag, sql"


# ---- scans


@_query("SELECT file, count(*)::BIGINT AS lines FROM r GROUP BY file")
def scan_count(spark, d):
    return logs.scan_logs(spark, write_log_files(spark, d)).groupBy("file").agg(F.count("*").alias("lines"))


@_query(f"SELECT file, pos, {_META}, exec_time_ms, row_count, exec_id FROM r")
def parse_records(spark, d):
    return records(spark, d).drop("parse_ok")


@_query("SELECT file, (count(*) FILTER (WHERE NOT bad))::BIGINT AS good, (count(*) FILTER (WHERE bad))::BIGINT AS bad FROM (SELECT file, false AS bad FROM r UNION ALL SELECT file, true FROM w WHERE k % 500 = 0) GROUP BY file")
def parse_errors(spark, d):
    return records(spark, d, bad=True).groupBy("file").agg(F.count_if("parse_ok").alias("good"), F.count_if(~F.col("parse_ok")).alias("bad"))


def _broken(lines):
    """Statements over several lines, and now and then a long one."""
    long = F.when(F.col("pos") % 14 == 1, F.concat(F.lit("VALUES\n"), F.expr("repeat(' \n', 400)"))).otherwise(F.lit("VALUES\n"))
    return lines.withColumn("value", F.replace(F.replace("value", F.lit(" WHERE "), F.lit("\nWHERE\n")), F.lit("VALUES "), long))


@_query("SELECT file, ts, tag, trx_id, exec_id, replace(replace(sql, ' WHERE ', chr(10) || 'WHERE' || chr(10)), 'VALUES ', 'VALUES' || chr(10) || CASE WHEN pos % 14 = 1 THEN repeat(' ' || chr(10), 400) ELSE '' END) AS sql FROM r")
def scan_multiline(spark, d):
    # blocks of 128 KB: each file is read by several tasks, with records over the ends
    lines = blocks.read_records(spark, write_log_files(spark, d, _broken), 1 << 17)
    return logs.parse_sqllog(lines).select("file", "ts", "tag", "trx_id", "exec_id", "sql")


@_query("SELECT file, ts, exec_id, replace(username, 'USER', '用户') AS username, replace(sql, 'orders', '订单€') AS sql FROM r")
def scan_gb18030_records(spark, d):
    def foreign(lines):
        text = F.replace(F.replace("value", F.lit("user:USER"), F.lit("user:用户")), F.lit("orders"), F.lit("订单€"))
        return lines.withColumn("value", F.encode(text, "GB18030").cast("string"))

    name = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")  # Spark encodes by this name only with its older rules
    try:
        lines = logs.decode_gb18030(spark, write_log_files(spark, d, foreign))
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return logs.parse_sqllog(lines).select("file", "ts", "exec_id", "username", "sql")


def _changed(spark, d):
    """A folder whose files were read once, then changed: even years came, 1995 got another text, 1997 went."""
    folder = write_log_files(spark, d, lambda lines: lines.filter("substring(file, 8, 4) % 2 = 1"))
    kept = Incremental(spark, folder, shared_folder(spark, "kept"), PARTS)
    kept.update()
    other = F.when(F.col("file") == "orders_1995.log", F.replace("value", F.lit("INSERT INTO orders"), F.lit("INSERT INTO old"))).otherwise(F.col("value"))
    write_log_files(spark, d, lambda lines: lines.filter("substring(file, 8, 4) % 2 = 0 OR file = 'orders_1995.log'").withColumn("value", other), folder)
    remove(spark, [f"{folder}/orders_1997.log"])
    kept.update()
    return kept


_THEN = ", x AS (SELECT * REPLACE (CASE WHEN file = 'orders_1995.log' THEN replace(fp, 'INSERT INTO orders', 'INSERT INTO old') ELSE fp END AS fp) FROM r WHERE file <> 'orders_1997.log') "


@_query(_THEN + "SELECT fp AS fingerprint, count(*)::BIGINT AS count, round(sum(coalesce(exec_time_ms, 0)), 4) AS total_ms, max(coalesce(exec_time_ms, 0)) AS max_ms, arg_min(ts, file || printf('%020d', pos)) AS first_seen FROM x GROUP BY fp")
def incremental_digest(spark, d):
    return partials.digest_of(_changed(spark, d).read("digest")).select("fingerprint", "count", *_r4("total_ms"), "max_ms", "first_seen")


@_query(_THEN + "SELECT substr(ts, 1, 13) AS bucket, count(*)::BIGINT AS count, round(sum(coalesce(exec_time_ms, 0)), 4) AS total_ms, max(coalesce(exec_time_ms, 0)) AS max_ms FROM x GROUP BY 1")
def incremental_buckets(spark, d):
    return partials.buckets_of(_changed(spark, d).read("minute")).select("bucket", "count", *_r4("total_ms"), "max_ms")


@_query("SELECT file, ts, trx_id, sql FROM r WHERE file NOT IN ('orders_1995.log', 'orders_1997.log') AND ts >= '1998-03' AND (ts <= '1999-06' OR starts_with(ts, '1999-06')) AND trx_id::INT % 9 = 0 AND trx_id::INT < 3600")
def skip_files(spark, d):
    found = _changed(spark, d).records("1998-03", "1999-06", [str(i) for i in range(0, 3600, 9)])
    return found.filter("parse_ok").select("file", "ts", "trx_id", "sql")


@_query("SELECT row_number() OVER (ORDER BY file, pos)::BIGINT AS rank, file, pos, sql FROM r")
def ordered_rows(spark, d):
    return shaping.with_rank(records(spark, d).select("file", "pos", "sql"), "file", "pos")


def _listing(spark, d):
    lines = log_lines(spark, d)
    return lines.groupBy("file").agg(F.sum(F.length("value") + 1).alias("size"), F.count("*").alias("mtime")).select("file", F.concat(F.lit("/logs/"), "file").alias("path"), "size", "mtime")


def _manifest(listing):
    year = F.substring("file", 8, 4).cast("int")
    same = listing.filter(year % 2 == 1)
    return same.unionByName(listing.filter(year == 1996).withColumn("size", F.col("size") + 1))


@_query("SELECT DISTINCT file FROM w WHERE substr(file, 8, 4)::INT % 2 = 0")
def incremental_new_files(spark, d):
    listing = _listing(spark, d)
    return logs.new_files(listing, _manifest(listing)).select("file")


@_query("SELECT file, CASE WHEN substr(file, 8, 4)::INT % 2 = 0 THEN 'new' ELSE 'skipped' END AS state, count(*)::BIGINT AS lines FROM r GROUP BY 1, 2")
def manifest_upsert(spark, d):
    listing = _listing(spark, d)
    manifest = _manifest(listing)
    after = logs.mark_done(manifest, logs.new_files(listing, manifest))
    done = logs.skipped_files(listing, after)
    new = logs.new_files(listing, manifest).select("file", F.lit("new").alias("state"))
    return done.join(new, "file", "left").select("file", F.coalesce("state", F.lit("skipped")).alias("state"), F.col("mtime").alias("lines"))


# ---- shaping


@_query("SELECT sql, username, exec_id, ts FROM r")
def project_fields(spark, d):
    return shaping.project(records(spark, d).withColumn("normalized_sql", F.lit(None)), ["sql", "username", "exec_id", "ts"])


@_query(f"SELECT ts, ep, sess_id, thrd_id, username, trx_id, statement, appname, replace(client_ip, '::ffff:', '') AS client_ip, tag, sql FROM r")
def project_no_metrics(spark, d):
    return shaping.export_rows(records(spark, d), normalized=False, metrics=False)


@_query("SELECT client_ip, CASE WHEN starts_with(client_ip, '::ffff:') THEN substr(client_ip, 8) ELSE client_ip END AS plain, count(*)::BIGINT AS n FROM r GROUP BY 1, 2")
def strip_ip(spark, d):
    return records(spark, d).groupBy("client_ip", X.strip_mapped_ip(F.col("client_ip")).alias("plain")).agg(F.count("*").alias("n"))


@_query("SELECT k, trunc(price * 1.7)::BIGINT AS ms FROM w JOIN (SELECT o_orderkey AS k, o_totalprice AS price FROM orders) USING (k)")
def exec_ms_int(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("k"), X.whole_ms(F.col("o_totalprice") * 1.7).alias("ms"))


@_query("SELECT file, pos, CASE WHEN exec_time_ms IS NOT NULL AND (exec_time_ms > 0 OR exec_id <> 0 OR row_count <> 0) THEN exec_time_ms::BIGINT END AS exec_time_ms, CASE WHEN exec_time_ms > 0 OR exec_id <> 0 OR row_count <> 0 THEN row_count END AS row_count, CASE WHEN exec_time_ms > 0 OR exec_id <> 0 OR row_count <> 0 THEN exec_id END AS exec_id FROM r")
def metrics_nulling(spark, d):
    return shaping.export_rows(records(spark, d), keep_order=True).select("file", "pos", "exec_time_ms", "row_count", "exec_id")


# ---- filters


def _kept(sql: str) -> str:
    return f"SELECT file, pos, ts, username FROM r WHERE {sql}"


def _filtered(spark, d, test):
    return records(spark, d).filter(test).select("file", "pos", "ts", "username")


@_query(_kept("ts >= '1996-02' AND (ts <= '1997-03-15' OR starts_with(ts, '1997-03-15'))"))
def filter_time_range(spark, d):
    return _filtered(spark, d, filters.time_range("1996-02", "1997-03-15"))


@_query(_kept("(regexp_matches(username, 'USER[12]') OR regexp_matches(username, '5$')) AND regexp_matches(appname, '^App[0-2]$')"))
def filter_include_regex(spark, d):
    return _filtered(spark, d, filters.include({"username": ["USER[12]", "5$"], "appname": ["^App[0-2]$"], "client_ip": []}))


@_query(_kept("NOT (regexp_matches(username, 'USER[12]') OR regexp_matches(client_ip, '^10\\.'))"))
def filter_exclude_regex(spark, d):
    return _filtered(spark, d, filters.exclude({"username": ["USER[12]"], "client_ip": [r"^10\."]}))


@_query(_kept("trx_id IN ('1', '7', '70', '700')"))
def filter_trxids(spark, d):
    return filters.by_trx_ids(records(spark, d), ["1", "7", "70", "700"]).select("file", "pos", "ts", "username")


@_query("SELECT 'wanted' AS rule, file, pos FROM r WHERE tag IS NOT NULL AND regexp_matches(tag, 'SEL|INS') UNION ALL SELECT 'unwanted', file, pos FROM r WHERE tag IS NULL OR NOT regexp_matches(tag, 'SEL')")
def filter_tags(spark, d):
    r = records(spark, d)
    wanted = r.filter(filters.tags(["SEL|INS"])).select(F.lit("wanted").alias("rule"), "file", "pos")
    return wanted.unionByName(r.filter(filters.tags(unwanted=["SEL"])).select(F.lit("unwanted").alias("rule"), "file", "pos"))


@_query(_kept("tag IS NULL OR (regexp_matches(sql, '(?i)select') AND NOT regexp_matches(sql, 'URGENT'))"))
def filter_record_sql(spark, d):
    return _filtered(spark, d, filters.record_sql(["(?i)select"], ["URGENT"]))


@_query(_kept("ts >= '1996' AND (contains(username, 'ER3') OR contains(appname, 'pp4') OR trx_id = '9')"))
def stats_filter_any(spark, d):
    return _filtered(spark, d, filters.stats_any({"username": ["ER3"], "appname": ["pp4"]}, ["9"], start="1996"))


_LISTED_KEY = "k % 7 = 3 AND k < 60000"


@_query(f"SELECT 'words' AS rule, file, pos FROM r WHERE tag IS NOT NULL AND k % 3 > 0 AND {_LISTED_KEY} UNION ALL SELECT 'patterns', file, pos FROM r WHERE tag IS NULL OR NOT (tag = 'UPD' OR k % 3 = 1 AND {_LISTED_KEY})")
def filter_many_words(spark, d):
    """17,142 words in statements, and 8,571 plain patterns beside one that is not plain."""
    r = records(spark, d)
    words = [w for k in range(3, 60_000, 7) for w in (f"o_orderkey = {k} AND", f"in ({k}, ")]
    by_words = r.filter(filters.txn_sql(words)).select(F.lit("words").alias("rule"), "file", "pos")
    by_patterns = r.filter(filters.exclude({"tag": ["^UPD$"], "sql": [w for w in words if "=" in w]}))
    return by_words.unionByName(by_patterns.select(F.lit("patterns").alias("rule"), "file", "pos"))


@_query(_kept("coalesce(exec_id IN (5, 6, 7), false) OR coalesce(exec_time_ms >= 4900, false) OR coalesce(row_count >= 98, false)"))
def indicator_match(spark, d):
    return _filtered(spark, d, filters.indicators([5, 6, 7], 4900, 98))


@_query(_kept("(contains(sql, 'URGENT') OR contains(sql, 'in (1')) AND NOT contains(sql, 'PARAMS')"))
def txn_sql_match(spark, d):
    return _filtered(spark, d, filters.txn_sql(["URGENT", "in (1"], ["PARAMS"]))


@_query(f"SELECT file, pos, {_META} FROM r WHERE trx_id IN (SELECT trx_id FROM r WHERE exec_time_ms >= 4950 OR contains(sql, 'in (77')) OR trx_id = '3'")
def txn_retention(spark, d):
    test = filters.indicators(min_ms=4950) | filters.txn_sql(["in (77"])
    return filters.retain_transactions(records(spark, d), test, ["3"]).select("file", "pos", *[c.strip() for c in _META.split(",")])


@_query(_kept("ts >= '1996' AND regexp_matches(username, 'USER[0-3]') AND tag IS NOT NULL AND NOT regexp_matches(tag, 'UPD') AND row_count < 50"))
def filter_pipeline(spark, d):
    steps = [filters.time_range("1996"), filters.include({"username": ["USER[0-3]"]}), filters.tags(["."], ["UPD"]), lambda r: r["row_count"] < 50]
    return filters.pipeline(records(spark, d), steps).select("file", "pos", "ts", "username")


# ---- binding

_LAST = """, b AS (
  SELECT file, pos, sess_id, statement, tag, sql, k, lead_k, pr FROM (
    SELECT r.*, last_value(CASE WHEN r.tag IS NULL THEN r.k END IGNORE NULLS) OVER (PARTITION BY file, sess_id, statement ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lead_k
    FROM r) x LEFT JOIN (SELECT o_orderkey AS ok, o_orderpriority AS pr FROM orders) ON ok = lead_k
)
"""


@_query(_LAST + "SELECT file, pos, tag, CASE WHEN tag IS NOT NULL AND k % 3 = 0 AND lead_k IS NOT NULL THEN 'INSERT INTO orders VALUES (' || lead_k || ', ''' || pr || ''')' END AS normalized_sql FROM b")
def bind_params(spark, d):
    return binding.bind_params(records(spark, d)).select("file", "pos", "tag", "normalized_sql")


@_query(_LAST + "SELECT file, pos, tag, CASE WHEN tag IS NOT NULL AND k % 3 = 0 AND lead_k IS NOT NULL THEN sql END AS normalized_sql FROM b")
def bind_params_forced(spark, d):
    return binding.bind_params(records(spark, d), "ordinal").select("file", "pos", "tag", "normalized_sql")


# all records as one session of one file, and slices of 200 places: most slices take what another one left
_ONE = """, b AS (
  SELECT pos, tag, k, lead_k, pr FROM (
    SELECT r.*, last_value(CASE WHEN r.tag IS NULL THEN r.k END IGNORE NULLS) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lead_k
    FROM r WHERE tag IS NOT NULL OR k % 900 = 0) x LEFT JOIN (SELECT o_orderkey AS ok, o_orderpriority AS pr FROM orders) ON ok = lead_k
)
"""


@_query(_ONE + "SELECT pos, tag, CASE WHEN tag IS NOT NULL AND k % 3 = 0 AND lead_k IS NOT NULL THEN 'INSERT INTO orders VALUES (' || lead_k || ', ''' || pr || ''')' END AS normalized_sql FROM b")
def bind_one_session(spark, d):
    one = records(spark, d).filter("tag IS NOT NULL OR pos % 1800 = 0").withColumns({c: F.lit("x") for c in ("file", "sess_id", "statement")})
    return binding.bind_params(one, width=200).select("pos", "tag", "normalized_sql")


@_query("SELECT p.file, p.pos, '[' || k || ', ''' || o_orderpriority || ''']' AS values FROM p JOIN orders ON o_orderkey = k")
def parse_params(spark, d):
    p = records(spark, d).filter(F.col("tag").isNull())
    return p.select("file", "pos", F.concat(F.lit("["), F.array_join(X.params(F.col("sql")), ", "), F.lit("]")).alias("values"))


@_query("SELECT sql, CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END::BIGINT AS n, false AS ordinal, count(*)::BIGINT AS c FROM w GROUP BY 1, 2")
def count_placeholders(spark, d):
    w = records(spark, d).filter(F.col("tag").isNotNull()).groupBy("sql").agg(F.count("*").alias("c"))
    p = X.placeholders(F.col("sql"))
    return w.select("sql", p["n"].cast("long").alias("n"), p["ordinal"].alias("ordinal"), "c")


# ---- statistics


@_query("SELECT count(DISTINCT file)::BIGINT AS files, count(*)::BIGINT AS records, (SELECT count(*) FROM w WHERE k % 500 = 0)::BIGINT AS errors, (SELECT count(DISTINCT file) FROM w WHERE substr(file, 8, 4)::INT % 2 = 1)::BIGINT AS skipped FROM r")
def stats_totals(spark, d):
    listing = _listing(spark, d)
    return stats.totals(records(spark, d, bad=True), listing, logs.skipped_files(listing, _manifest(listing)))



@_query("SELECT file, count(*)::BIGINT AS records, (count(*) FILTER (WHERE tag IS NOT NULL AND k % 500 = 0))::BIGINT AS errors FROM r GROUP BY file UNION ALL SELECT 'empty.log', 0, 0")
def stats_per_file(spark, d):
    listing = log_lines(spark, d).select("file").unionByName(spark.range(1).select(F.lit("empty.log").alias("file")))
    return stats.per_file(records(spark, d, bad=True), listing)


def _load_sql(key: str) -> str:
    return f"SELECT {key}, count(*)::BIGINT AS count, round(sum(coalesce(exec_time_ms, 0)), 4) AS total_ms, round(sum(coalesce(exec_time_ms, 0)) / count(*), 4) AS avg_ms, round(max(coalesce(exec_time_ms, 0)), 4) AS max_ms FROM r GROUP BY ALL"


def _load(df, *keys):
    return df.select(*keys, "count", *_r4("total_ms", "avg_ms", "max_ms"))


_USER = "CASE WHEN username = '' THEN '(unknown)' ELSE username END"


@_query(_load_sql(f"{_USER} AS key"))
def group_by_user(spark, d):
    return _load(stats.group_by(records(spark, d), "user"), "key")


@_query(_load_sql("appname AS key"))
def group_by_app(spark, d):
    return _load(stats.group_by(records(spark, d), "app"), "key")


@_query(_load_sql("client_ip AS key"))
def group_by_ip(spark, d):
    return _load(stats.group_by(records(spark, d), "ip"), "key")


@_query(f"({_load_sql(f"'user' AS section, {_USER} AS key")}) UNION ALL ({_load_sql("'app' AS section, appname AS key")})")
def group_sections(spark, d):
    return _load(stats.group_sections(records(spark, d), ["user", "app", "user"]), "section", "key")


@_query(_load_sql("substr(ts, 1, 13) AS bucket"))
def bucket_hour(spark, d):
    return _load(stats.buckets(records(spark, d), "hour"), "bucket")


@_query(_load_sql("substr(ts, 1, 16) AS bucket"))
def bucket_minute(spark, d):
    return _load(stats.buckets(records(spark, d), "minute"), "bucket")


@_query("SELECT bucket, count, count * 20 // max(count) OVER () AS bar_len, repeat('█', (count * 20 // max(count) OVER ())::INT) AS bar FROM (SELECT substr(ts, 1, 13) AS bucket, count(*)::BIGINT AS count FROM r GROUP BY 1)")
def bucket_bar(spark, d):
    return stats.bucket_bars(stats.buckets(records(spark, d), "hour")).select("bucket", "count", "bar_len", "bar")


@_query("SELECT row_number() OVER (ORDER BY exec_time_ms DESC, ts, file, pos)::BIGINT AS rank, exec_time_ms, ts, substr(sql, 1, 120) AS sql, file FROM r WHERE exec_time_ms IS NOT NULL ORDER BY exec_time_ms DESC, ts, file, pos LIMIT 20")
def slow_top_n(spark, d):
    return stats.slowest(records(spark, d), 20).withColumn("rank", F.col("rank").cast("long"))


def _digest_sql(having: str = "", order: str = "count DESC", limit: str = "") -> str:
    return f"""SELECT row_number() OVER (ORDER BY {order}, fp)::BIGINT AS rank, fp AS fingerprint, count, round(total_ms, 4) AS total_ms, round(total_ms / count, 4) AS avg_ms, max_ms, substr(example, 1, 120) AS example, first_seen
      FROM (SELECT fp, count(*)::BIGINT AS count, sum(coalesce(exec_time_ms, 0)) AS total_ms, max(coalesce(exec_time_ms, 0)) AS max_ms, arg_min(sql, file || printf('%020d', pos)) AS example, arg_min(ts, file || printf('%020d', pos)) AS first_seen FROM r GROUP BY fp) {having} ORDER BY {order}, fp {limit}"""


def _digest(df):
    return df.select(F.col("rank").cast("long").alias("rank"), "fingerprint", "count", *_r4("total_ms", "avg_ms"), "max_ms", "example", "first_seen")


@_query(_digest_sql())
def digest_by_count(spark, d):
    return _digest(digest_job(records(spark, d)))


@_query(_digest_sql(order="total_ms DESC"))
def digest_by_exec(spark, d):
    return _digest(digest_job(records(spark, d), by="exec"))


@_query(_digest_sql(having="WHERE count >= (SELECT count(*) // 4 FROM w)"))
def digest_min_count(spark, d):
    n = spark.read.parquet(f"{d}/orders.parquet").count()
    return _digest(digest_job(records(spark, d), min_count=n // 4))


@_query(_digest_sql(limit="LIMIT 2"))
def digest_top_n(spark, d):
    return _digest(digest_job(records(spark, d), top=2))


# ---- templates and chart data

_US = "greatest(1, least(60000000, trunc(coalesce(exec_time_ms, 0) * 1000)))::BIGINT"
_LOW = "((us >> greatest(0, floor(log2(us))::INT - 7)) << greatest(0, floor(log2(us))::INT - 7))"
_HIGH = f"({_LOW} + (1::BIGINT << greatest(0, floor(log2(us))::INT - 7)) - 1)"


@_query(f"SELECT template AS template_key, count(*)::BIGINT AS count, floor(sum(us) / count(*))::BIGINT AS avg_us, min(us) AS min_us, max(us) AS max_us, quantile_disc(us, 0.5) AS p50_us, quantile_disc(us, 0.95) AS p95_us, quantile_disc(us, 0.99) AS p99_us, min(ts) AS first_seen, max(ts) AS last_seen FROM (SELECT *, {_US} AS us FROM w) GROUP BY template")
def template_stats(spark, d):
    return templates.template_stats(templates.observed(records(spark, d)))


@_query(f"SELECT template AS template_key, count(*)::BIGINT AS count, min(low)::BIGINT AS min_us, max(high)::BIGINT AS max_us, quantile_disc(high, 0.5)::BIGINT AS p50_us, quantile_disc(high, 0.95)::BIGINT AS p95_us, quantile_disc(high, 0.99)::BIGINT AS p99_us FROM (SELECT *, {_LOW} AS low, {_HIGH} AS high FROM (SELECT *, {_US} AS us FROM w)) GROUP BY template")
def template_stats_hdr(spark, d):
    return templates.template_stats(templates.observed(records(spark, d)), "hdr").select("template_key", "count", "min_us", "max_us", "p50_us", "p95_us", "p99_us")


@_query(f"SELECT template AS template_key, count(*)::BIGINT AS count, min({_US}) AS min_us, max({_US}) AS max_us, min(ts) AS first_seen, max(ts) AS last_seen FROM w GROUP BY template")
def template_merge(spark, d):
    r = records(spark, d)
    even = F.substring("file", 11, 1).cast("int") % 2 == 0
    both = templates.merged([templates.observed(r.filter(even)), templates.observed(r.filter(~even))])
    return templates.template_stats(both).select("template_key", "count", "min_us", "max_us", "first_seen", "last_seen")


_TOP = "SELECT template FROM w GROUP BY template ORDER BY count(*) DESC, template LIMIT 5"


@_query(f"SELECT template AS template_key, {_LOW}::BIGINT AS bucket_low, {_HIGH}::BIGINT AS bucket_high, count(*)::BIGINT AS count FROM (SELECT *, {_US} AS us FROM w) WHERE template IN ({_TOP}) GROUP BY ALL")
def latency_histogram(spark, d):
    return templates.latency_histogram(templates.observed(records(spark, d)), 5)


@_query("SELECT count(DISTINCT template)::BIGINT AS templates FROM w")
def template_count(spark, d):
    return templates.template_count(templates.observed(records(spark, d)))


@_query("SELECT template AS template_key, CASE WHEN length(template) > 40 THEN substr(template, 1, 39) || '…' ELSE template END AS label, count(*)::BIGINT AS count FROM w GROUP BY template ORDER BY count(*) DESC, template LIMIT 10")
def top_templates(spark, d):
    return templates.top_templates(templates.template_stats(templates.observed(records(spark, d))), 10)


@_query("SELECT substr(ts, 1, 13) AS hour, count(*)::BIGINT AS count FROM w GROUP BY 1")
def trend_hourly(spark, d):
    return templates.hourly(records(spark, d))


@_query("SELECT substr(ts, 1, 13) AS hour, count(*)::BIGINT AS count, substr(ts, 6, 5) || ' ' || substr(ts, 12, 2) || ':00' AS label FROM w GROUP BY ALL")
def trend_labels(spark, d):
    return templates.trend_labels(templates.hourly(records(spark, d)))


@_query("SELECT username, count(*)::BIGINT AS count FROM w WHERE username <> '' GROUP BY 1")
def user_counts(spark, d):
    return templates.user_counts(records(spark, d))


@_query("SELECT slice, sum(count)::BIGINT AS count, round(100 * sum(count) / sum(sum(count)) OVER (), 4) AS share FROM (SELECT CASE WHEN row_number() OVER (ORDER BY count(*) DESC, username) <= 4 THEN username ELSE 'Others' END AS slice, count(*) AS count FROM w WHERE username <> '' GROUP BY username) GROUP BY slice")
def user_share(spark, d):
    return templates.user_share(templates.user_counts(records(spark, d)), 4).withColumn("share", F.round("share", 4)).drop("rest")


# ---- text


@_query("SELECT sql, fp AS fingerprint, count(*)::BIGINT AS n FROM r GROUP BY 1, 2")
def fingerprint(spark, d):
    return records(spark, d).groupBy("sql").agg(F.count("*").alias("n")).withColumn("fingerprint", X.fingerprint(F.col("sql")))


@_query("SELECT sql, template, count(*)::BIGINT AS n FROM w GROUP BY 1, 2")
def template_normalize(spark, d):
    return records(spark, d).filter(F.col("tag").isNotNull()).groupBy("sql").agg(F.count("*").alias("n")).withColumn("template", X.template(F.col("sql")))


@_query("SELECT sql, substr(regexp_replace(sql, '[^A-Za-z0-9_-]', '_', 'g'), 1, 80) AS key, count(*)::BIGINT AS n FROM r GROUP BY 1, 2")
def safe_key(spark, d):
    return records(spark, d).groupBy("sql").agg(F.count("*").alias("n")).withColumn("key", X.safe_key(F.col("sql")))


def _nest(sql):
    """A statement with the list of the given one in up to 41 more brackets, every fifth one with a sub-query."""
    n = (F.col("pos") % 41).cast("int")
    inner = F.concat(F.when(F.col("pos") % 5 == 0, "select ").otherwise(""), F.lit("("), F.regexp_extract(sql, r"in \((.*?)\)", 1), F.lit(")"))
    return F.concat(F.lit("delete from q where k in "), F.repeat(F.lit("("), n + 1), inner, F.repeat(F.lit(")"), n + 1), F.lit(" and m in (1, (2))"))


@_query("SELECT file, pos, CASE WHEN pos % 5 = 0 THEN 'DELETE FROM q WHERE k IN ' || repeat('(', (pos % 41 + 1)::INT) || 'SELECT (' || k || ', ' || (k + 1) || ')' || repeat(')', (pos % 41 + 1)::INT) || ' AND m IN (?)' ELSE 'DELETE FROM q WHERE k IN (?) AND m IN (?)' END AS template FROM w WHERE k % 3 = 2")
def template_deep_lists(spark, d):
    lists = records(spark, d).filter("tag IS NOT NULL AND sql LIKE '% in (%'")
    return lists.select("file", "pos", X.template(_nest(F.col("sql"))).alias("template"))


# ---- limits, unions, sinks


@_query("SELECT file, pos, sql FROM r ORDER BY file, pos LIMIT 500")
def limit_export(spark, d):
    return shaping.first_records(records(spark, d), 500).select("file", "pos", "sql")


@_query("SELECT file, pos, sql FROM r")
def union_parts(spark, d):
    r = records(spark, d)
    return shaping.concatenate([r.filter("ep = 0"), r.filter("ep = 1"), r.filter("ep > 1")]).select("file", "pos", "sql")


_EXPORT = "SELECT ts, ep, sess_id, thrd_id, username, trx_id, statement, appname, replace(client_ip, '::ffff:', '') AS client_ip, tag, sql, exec_time_ms::BIGINT AS exec_time_ms, row_count, exec_id FROM r"


def _export(spark, d):
    return export_job(records(spark, d), bind=False).drop("normalized_sql")


@_query(_EXPORT)
def csv_roundtrip(spark, d):
    rows, path = _export(spark, d), shared_folder(spark, "csv")
    sinks.write_csv(rows, path)
    # an empty field is null in CSV; these fields are never null in a record
    back = sinks.read_csv(spark, path, rows.schema)
    return back.na.fill("", ["thrd_id", "username"])


def _table(spark, d, steps):
    rows, name = _export(spark, d), f"t_{uuid.uuid4().hex}"
    for step in steps:
        sinks.write_table(rows, name, **step)
    return spark.table(name)


@_query(_EXPORT)
def table_overwrite(spark, d):
    return _table(spark, d, [{}, {"overwrite": True}])


@_query(f"{_EXPORT} UNION ALL {_EXPORT}")
def table_append(spark, d):
    return _table(spark, d, [{}, {"append": True}])


@_query(_EXPORT)
def table_truncate(spark, d):
    return _table(spark, d, [{}, {"append": True}, {}])


@_query(f"SELECT template AS template_key, count(*)::BIGINT AS count, floor(sum(us) / count(*))::BIGINT AS avg_us, min(us) AS min_us, max(us) AS max_us, quantile_disc(us, 0.5) AS p50_us, quantile_disc(us, 0.95) AS p95_us, quantile_disc(us, 0.99) AS p99_us, min(ts) AS first_seen, max(ts) AS last_seen FROM (SELECT *, {_US} AS us FROM w) GROUP BY template")
def template_table(spark, d):
    name = f"sql_templates_{uuid.uuid4().hex}"
    sinks.write_templates(template_stats(spark, d), table=name)
    return spark.table(name)


@_query("SELECT count(*)::BIGINT AS exported, ((SELECT count(*) FROM r) - count(*))::BIGINT AS skipped, (SELECT count(*) FROM w WHERE k % 500 = 0)::BIGINT AS failed FROM r WHERE regexp_matches(username, 'USER[12]')")
def export_counters(spark, d):
    read = records(spark, d, bad=True)
    return export_counts(read, export_job(read, patterns={"username": ["USER[12]"]}, bind=False))


@_query("SELECT count(*)::BIGINT AS exported, ((SELECT count(*) FROM r) - count(*))::BIGINT AS skipped, (SELECT count(*) FROM w WHERE k % 500 = 0)::BIGINT AS failed, count(*)::BIGINT AS written FROM r WHERE regexp_matches(username, 'USER[12]')")
def export_one_pass(spark, d):
    path = shared_folder(spark, "csv")
    counts = export_counted(records(spark, d, bad=True), lambda rows: sinks.write_csv(rows, path), patterns={"username": ["USER[12]"]}, bind=False)
    written = sinks.read_csv(spark, path, export_job(records(spark, d), bind=False).schema).agg(F.count("*").alias("written"))
    return written.select(*[F.lit(counts[n]).cast("long").alias(n) for n in ("exported", "skipped", "failed")], "written")


@_query("SELECT file, pos, sql FROM r WHERE trx_id IN (SELECT trx_id FROM r WHERE exec_time_ms >= 4950) OR trx_id IN ('3', '5')")
def export_transactions(spark, d):
    read = records(spark, d)
    kept = export_job(read.withColumn("sql", F.to_json(F.struct("file", "pos", "sql"))), transactions=filters.indicators(min_ms=4950), trx_ids=["3", "5"], ordered=True, bind=False)
    x = F.from_json("sql", "file string, pos long, sql string")
    return kept.select(x.alias("x")).select("x.*")


@_query("SELECT DISTINCT file FROM w WHERE substr(file, 8, 4)::INT % 2 = 0")
def incremental_log_files(spark, d):
    listing = logs.list_logs(spark, write_log_files(spark, d))
    return logs.new_files(listing, listing.filter(F.substring("file", 8, 4).cast("int") % 2 == 1)).select("file")


@_query("SELECT file, count(*)::BIGINT AS lines FROM r GROUP BY file")
def scan_gb18030(spark, d):
    return logs.decode_gb18030(spark, write_log_files(spark, d)).groupBy("file").agg(F.count("*").alias("lines"))


@_query(_digest_sql())
def json_report(spark, d):
    rows, path = _digest(digest_job(records(spark, d))), shared_folder(spark, "json")
    sinks.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@_query("""SELECT 'summary' AS section, NULL::BIGINT AS rank, NULL::VARCHAR AS fingerprint, NULL::BIGINT AS count, count(DISTINCT file)::BIGINT AS files, count(*)::BIGINT AS records, (SELECT count(*) FROM w WHERE k % 500 = 0)::BIGINT AS errors, 0::BIGINT AS skipped, count(DISTINCT fp)::BIGINT AS fingerprints, 2::BIGINT AS shown FROM r
UNION ALL SELECT * FROM (SELECT 'entries', row_number() OVER (ORDER BY count(*) DESC, fp)::BIGINT AS rank, fp, count(*)::BIGINT, NULL, NULL, NULL, NULL, NULL, NULL FROM r GROUP BY fp ORDER BY rank LIMIT 2)""")
def digest_json(spark, d):
    path = shared_folder(spark, "json")
    reports.json_lines(reports.digest_report(records(spark, d, bad=True), top=2)).write.text(path)
    return spark.read.schema("section string, rank long, fingerprint string, count long, files long, records long, errors long, skipped long, fingerprints long, shown long").json(path)


@_query("SELECT file, pos, replace(sql, '''', '\"') AS sql FROM r")
def csv_quotes(spark, d):
    rows, path = records(spark, d).select("file", "pos", F.translate("sql", "'", '"').alias("sql")), shared_folder(spark, "csv")
    sinks.write_csv(rows, path)
    return sinks.read_csv(spark, path, rows.schema)


@_query(f"SELECT template AS template_key, count(*)::BIGINT AS count, min(us) AS min_us, max(us) AS max_us, quantile_disc(us, 0.5) AS p50_us, min(ts) AS first_seen FROM (SELECT *, {_US} AS us FROM w) GROUP BY template")
def template_csv(spark, d):
    stats_, path = template_stats(spark, d), shared_folder(spark, "export")
    sinks.write_templates(stats_, csv_path=f"{path}.csv")
    return sinks.read_csv(spark, f"{path}_templates.csv", stats_.schema).select("template_key", "count", "min_us", "max_us", "p50_us", "first_seen")


@_query("SELECT count(*)::BIGINT AS exported FROM r WHERE regexp_matches(username, 'USER[12]') AND NOT regexp_matches(appname, 'App3') AND (tag IS NULL OR regexp_matches(sql, 'orders') AND NOT regexp_matches(sql, 'URGENT'))")
def dry_run(spark, d):
    rows = export_job(records(spark, d), patterns={"username": ["USER[12]"]}, unwanted={"appname": ["App3"]}, sql_patterns=(["orders"], ["URGENT"]), bind=False)
    return spark.createDataFrame([(sinks.dry_run(rows)["exported"],)], "exported long")


@_query("SELECT trx_id, count(*)::BIGINT AS n FROM r GROUP BY 1")
def own_sink(spark, d):
    name = f"own_{uuid.uuid4().hex}"
    sinks.export(records(spark, d), sink=lambda rows: rows.groupBy("trx_id").agg(F.count("*").alias("n")).write.saveAsTable(name))
    return spark.table(name)


@_query("SELECT file, count(*)::BIGINT AS n, count(exec_id)::BIGINT AS ids FROM r GROUP BY file")
def export_new_files(spark, d):
    """Three runs over a growing folder append what is new; each row is exported once."""
    folder, path = shared_folder(spark, "logs"), shared_folder(spark, "csv")
    kept = Incremental(spark, folder, shared_folder(spark, "kept"), {})
    for part in (0, 1, 1):
        if kept.manifest.version() <= part:
            write_log_files(spark, d, lambda lines, part=part: lines.filter(F.col("file").substr(8, 4).cast("int") % 2 == part), folder)
        export_new(kept, lambda rows: sinks.write_csv(rows, path, append=True), bind=False)
    rows = sinks.read_csv(spark, path, export_job(records(spark, d), bind=False).schema)
    named = F.concat(F.lit("orders_"), F.substring(F.col("ts"), 1, 4), F.lit(".log"))
    return rows.groupBy(named.alias("file")).agg(F.count("*").alias("n"), F.count("exec_id").alias("ids"))


# ---- streams


@_query("SELECT file, username, count(*)::BIGINT AS n FROM r GROUP BY 1, 2")
def stream_ingest(spark, d):
    rows = streams.stream_records(spark, write_log_files(spark, d)).filter("parse_ok").select("file", "username", "ts")
    done = streams.run_to_table(rows, shared_folder(spark, "ingest"), shared_folder(spark, "state"))
    return done.groupBy("file", "username").agg(F.count("*").alias("n"))


@_query("SELECT strftime(date_trunc('hour', ts::TIMESTAMP), '%Y-%m-%d %H') AS bucket, count(*)::BIGINT AS count, sum(coalesce(exec_time_ms, 0)) AS total_ms, max(coalesce(exec_time_ms, 0)) AS max_ms FROM r GROUP BY 1")
def stream_bucket(spark, d):
    rows = streams.stream_buckets(streams.stream_records(spark, write_log_files(spark, d)), late="36500 days")
    done = streams.run_to_table(rows, shared_folder(spark, "complete"), shared_folder(spark, "state"), "complete")
    return done.select(F.date_format("start", "yyyy-MM-dd HH").alias("bucket"), "count", "total_ms", "max_ms")


@_query("SELECT fp AS fingerprint, count(*)::BIGINT AS count, sum(coalesce(exec_time_ms, 0)) AS total_ms, min(ts) AS first_seen FROM r GROUP BY fp")
def stream_digest(spark, d):
    rows = streams.stream_digest(streams.stream_records(spark, write_log_files(spark, d)))
    done = streams.run_to_table(rows, shared_folder(spark, "complete"), shared_folder(spark, "state"), "complete")
    return done.select("fingerprint", "count", "total_ms", "first_seen")


def _numbered(lines):
    """Lines with their numbers before them."""
    return lines.withColumn("value", F.concat("pos", F.lit("|"), "value"))


@_query("SELECT file, pos, ts, trx_id, exec_id, sql FROM r UNION ALL SELECT file, pos, ts, trx_id, exec_id, sql FROM r WHERE file = 'orders_1992.log' AND pos > 3000")
def stream_tail(spark, d):
    """Files grow and one begins anew between three runs; a line arrives once, and again where its file began anew."""
    out, state, folder = shared_folder(spark, "tail"), shared_folder(spark, "state"), shared_folder(spark, "logs")
    steps = ("pos <= 4000", "true", "file <> 'orders_1992.log' OR pos > 3000")
    for shown in steps:
        write_log_files(spark, d, lambda lines, shown=shown: _numbered(lines).filter(shown), folder)
        done = streams.run_to_table(tail_lines(spark, folder, 1 << 18), out, state)
    rows = done.select("file", F.substring_index("value", "|", 1).cast("long").alias("pos"), F.expr("substring(value, instr(value, '|') + 1)").alias("value"))
    return logs.parse_sqllog(rows).select("file", "pos", "ts", "trx_id", "exec_id", "sql")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
