"""A SQL execution log rendered from the ``orders`` table, as ``FIXTURES.md`` lays down.

No input table is a log, so the queries render one, parse it again and work on what they parsed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.sources.logs import parse_sqllog
from auditlake.storage import join_files, remove, rename, shared_folder, stat_files


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), (k % 24).cast("int"), (k % 60).cast("int"))
    return o.select(
        k.alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_totalprice").alias("price"),
        F.concat(F.lit("orders_"), F.year("o_orderdate"), F.lit(".log")).alias("file"),
        F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSS").alias("ts"),
        F.concat(
            F.lit(" (EP["), k % 4, F.lit("] sess:"), F.format_string("0x%04x", c % 8), F.when(k % 2 == 0, F.concat(F.lit(" thrd:"), k % 97)).otherwise(""),
            F.lit(" user:"), F.when(k % 50 == 0, "").otherwise(F.concat(F.lit("USER"), c % 7)), F.lit(" trxid:"), F.floor(k / 4), F.lit(" stmt:"), F.format_string("0x%x", F.floor(k / 6) % 4),
            F.lit(" appname:App"), k % 5, F.lit(" ip:"), F.when(k % 10 == 0, "").otherwise("::ffff:"), F.lit("10.0."), c % 256, F.lit("."), k % 256, F.lit(") "),
        ).alias("head"),
        F.when(F.col("o_orderstatus") == "O", "SEL").when(F.col("o_orderstatus") == "F", "UPD").otherwise("INS").alias("tag"),
    )


def log_lines(spark: SparkSession, sf_dir: str, bad: bool = False) -> DataFrame:
    """``file, pos, value``: a statement per order, its parameter record before it, and optionally bad lines."""
    b = _base(spark, sf_dir)
    k = F.col("k")
    sql = (
        F.when(k % 3 == 0, "INSERT INTO orders VALUES (?, ?)")
        .when(k % 3 == 1, F.concat(F.lit("SELECT * FROM orders WHERE o_orderkey = "), k, F.lit(" AND o_orderpriority = '"), "p", F.lit("'")))
        .otherwise(F.concat(F.lit("select *  from orders where o_orderkey in ("), k, F.lit(", "), k + 1, F.lit(") /* c */")))
    )
    tail = F.when(k % 40 == 0, "").otherwise(F.concat(F.lit(". EXECTIME: "), F.floor("price") % 5000, F.lit("(ms) ROWCOUNT: "), k % 100, F.lit("(rows) EXEC_ID: "), k, F.lit(".")))
    line = F.concat("ts", "head", F.lit("["), "tag", F.lit("] "), sql, tail)
    given = F.when((k % 3 == 0) & (k % 6 != 3), F.concat("ts", "head", F.lit("PARAMS(SEQNO, TYPE, DATA)={(0, BIGINT, "), k, F.lit("), (1, VARCHAR, '"), "p", F.lit("')}")))
    junk = F.when((k % 500 == 0) & F.lit(bad), F.concat(F.lit("garbage "), k))
    rows = F.array(F.struct((2 * k).alias("pos"), given.alias("value")), F.struct((2 * k + 1).alias("pos"), line.alias("value")), F.struct((-1 - k).alias("pos"), junk.alias("value")))
    return b.select("file", F.explode(rows).alias("r")).select("file", "r.pos", "r.value").filter("value IS NOT NULL")


def records(spark: SparkSession, sf_dir: str, bad: bool = False) -> DataFrame:
    """The parsed records of :func:`log_lines`."""
    parsed = parse_sqllog(log_lines(spark, sf_dir, bad))
    return parsed if bad else parsed.filter("parse_ok")


def write_log_files(spark: SparkSession, sf_dir: str, shaped: Callable[[DataFrame], DataFrame] = lambda lines: lines, folder: str | None = None) -> str:
    """Write the lines, ``shaped`` as a test needs them, as one text file for each log file; returns the folder."""
    folder = folder or shared_folder(spark, "logs")
    # ranges of files and places: a large file is written by many tasks
    lines = shaped(log_lines(spark, sf_dir)).repartitionByRange("file", "pos").sortWithinPartitions("file", "pos")
    by = f"{folder}/by-{uuid.uuid4().hex}"
    lines.select("value", "file").write.partitionBy("file").text(by)
    parts: dict[str, list[str]] = {}
    for name, path, _, _ in sorted(stat_files(spark, by, "file=*/part-*")):  # the parts of a file in the order of its ranges
        parts.setdefault(path.split("file=")[1].split("/")[0], []).append(path)
    whole = {f: p[0] if len(p) == 1 else f"{p[0]}-whole" for f, p in parts.items()}
    join_files(spark, [(p, whole[f]) for f, p in parts.items() if len(p) > 1])
    remove(spark, [f"{folder}/{f}" for f in parts])
    rename(spark, [(new, f"{folder}/{f}") for f, new in whole.items()])
    remove(spark, [x for p in parts.values() if len(p) > 1 for x in p])
    return folder


#: The same log for DuckDB, straight from the table: ``w`` has the statements, ``p`` the parameter records, ``r`` both.
W_SQL = """
WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderpriority AS pr, o_totalprice AS price, o_orderdate AS dt FROM orders
), h AS (
  SELECT k, pr, 'orders_' || year(dt) || '.log' AS file,
    strftime(dt + to_hours((k % 24)::INT) + to_minutes((k % 60)::INT), '%Y-%m-%d %H:%M:%S.%g') AS ts, (k % 4)::INT AS ep,
    printf('0x%04x', c % 8) AS sess_id, CASE WHEN k % 2 = 0 THEN (k % 97)::VARCHAR ELSE '' END AS thrd_id,
    CASE WHEN k % 50 = 0 THEN '' ELSE 'USER' || (c % 7) END AS username, (k // 4)::VARCHAR AS trx_id,
    printf('0x%x', (k // 6) % 4) AS statement, 'App' || (k % 5) AS appname,
    CASE WHEN k % 10 = 0 THEN '' ELSE '::ffff:' END || '10.0.' || (c % 256) || '.' || (k % 256) AS client_ip,
    CASE st WHEN 'O' THEN 'SEL' WHEN 'F' THEN 'UPD' ELSE 'INS' END AS tag,
    CASE k % 3 WHEN 0 THEN 'INSERT INTO orders VALUES (?, ?)'
      WHEN 1 THEN 'SELECT * FROM orders WHERE o_orderkey = ' || k || ' AND o_orderpriority = ''' || pr || ''''
      ELSE 'select *  from orders where o_orderkey in (' || k || ', ' || (k + 1) || ') /* c */' END AS sql,
    CASE k % 3 WHEN 0 THEN 'INSERT INTO orders VALUES (?, ?)'
      WHEN 1 THEN 'SELECT * FROM orders WHERE o_orderkey = ? AND o_orderpriority = ?'
      ELSE 'select * from orders where o_orderkey in (?, ?) /* c */' END AS fp,
    CASE k % 3 WHEN 0 THEN 'INSERT INTO orders VALUES (?, ?)'
      WHEN 1 THEN 'SELECT * FROM orders WHERE o_orderkey = ' || k || ' AND o_orderpriority = ''' || pr || ''''
      ELSE 'SELECT * FROM orders WHERE o_orderkey IN (?)' END AS template,
    CASE WHEN k % 40 = 0 THEN NULL ELSE (floor(price)::BIGINT % 5000)::DOUBLE END AS exec_time_ms,
    CASE WHEN k % 40 = 0 THEN NULL ELSE k % 100 END AS row_count, CASE WHEN k % 40 = 0 THEN NULL ELSE k END AS exec_id
  FROM o
), w AS (
  SELECT k, file, 2 * k + 1 AS pos, ts, ep, sess_id, thrd_id, username, trx_id, statement, appname, client_ip, tag, sql, fp, template, exec_time_ms, row_count, exec_id FROM h
), p AS (
  SELECT k, file, 2 * k AS pos, ts, ep, sess_id, thrd_id, username, trx_id, statement, appname, client_ip, NULL::VARCHAR AS tag,
    'PARAMS(SEQNO, TYPE, DATA)={(0, BIGINT, ' || k || '), (1, VARCHAR, ''' || pr || ''')}' AS sql,
    'PARAMS(SEQNO, TYPE, DATA)={(?, BIGINT, ?), (?, VARCHAR, ?)}' AS fp, NULL::VARCHAR AS template,
    NULL::DOUBLE AS exec_time_ms, NULL::BIGINT AS row_count, NULL::BIGINT AS exec_id
  FROM h WHERE k % 3 = 0 AND k % 6 <> 3
), r AS (SELECT * FROM w UNION ALL SELECT * FROM p)
"""
