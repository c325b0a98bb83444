"""The three jobs: export, statistics, digest."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.binding import bind_params
from auditlake.operators.filters import check_patterns, exclude, include, indicators, pipeline, record_sql, retain_transactions, stats_any, time_range, txn_sql
from auditlake.operators.partials import buckets_of, digest_of
from auditlake.operators.shaping import export_rows, first_records, project
from auditlake.operators.stats import bucket_bars, buckets, digest, group_sections, slowest, top_digest, totals
from auditlake.schema import ORDER
from auditlake.sources.blocks import STORES, read_records, scheme
from auditlake.sources.logs import assemble, parse_sqllog, scan_logs
from auditlake.sources.manifest import Incremental


def load(spark: SparkSession, path: str, multiline: bool = False, tolerant: bool = False) -> DataFrame:
    """Parsed records of the logs at ``path``, bad ones marked; records of several lines block by block where tasks can open the store."""
    if multiline and not tolerant and scheme(path) in STORES:
        return parse_sqllog(read_records(spark, path))
    lines = scan_logs(spark, path, tolerant)
    return parse_sqllog(assemble(lines) if multiline else lines)


def export_job(
    records: DataFrame,
    steps: Iterable[Column | Callable[[DataFrame], Column]] = (),
    transactions: Column | None = None,
    fields: list[str] | None = None,
    bind: bool = True,
    style: str | None = None,
    limit: int | None = None,
    trx_ids: Iterable[str] = (),
    ordered: bool = False,
    patterns: Mapping[str, Iterable[str]] | None = None,
    unwanted: Mapping[str, Iterable[str]] | None = None,
    sql_patterns: tuple[Iterable[str], Iterable[str]] = ((), ()),
) -> DataFrame:
    """Bind, filter, keep whole transactions, shape, limit; binding comes first, so filters can't take its input away.

    Transactions are kept in which some record passes ``transactions``, and those in ``trx_ids``.
    ``ordered`` gives the rows in the order of files and records. ``patterns`` and ``unwanted``
    are patterns by field that keep or drop records, ``sql_patterns`` wanted and unwanted ones on
    statements; all are checked before anything runs.
    """
    steps = [*steps]
    patterns, unwanted, sql = patterns or {}, unwanted or {}, [[*p] for p in sql_patterns]
    check_patterns(records.sparkSession, patterns, unwanted, {"sql": [*sql[0], *sql[1]]})
    steps += [include(patterns)] * bool(patterns) + [exclude(unwanted)] * bool(unwanted) + [record_sql(*sql)] * bool(sql[0] or sql[1])
    good = records.filter("parse_ok")
    bound = bind_params(good, style) if bind else good
    kept = pipeline(bound, steps)
    given = [*trx_ids]
    if transactions is not None or given:
        matched = good.filter(F.lit(False) if transactions is None else transactions).select("trx_id")
        if given:
            matched = matched.unionByName(records.sparkSession.createDataFrame([(x,) for x in given], "trx_id string"))
        kept = kept.join(matched.distinct(), "trx_id", "left_semi").select(*kept.columns)
    if limit is not None:
        kept = first_records(kept, limit)
    shaped = export_rows(kept, keep_order=ordered)
    return project(shaped.orderBy(*ORDER) if ordered else shaped, fields)


def export_counts(records: DataFrame, exported: DataFrame) -> DataFrame:
    """One row: ``exported`` rows, good records that filters ``skipped``, and ``failed`` lines that are no record."""
    read = records.agg(F.count_if("parse_ok").alias("good"), F.count_if(~F.col("parse_ok")).alias("failed"))
    return read.join(F.broadcast(exported.agg(F.count("*").alias("exported")))).select("exported", (F.col("good") - F.col("exported")).alias("skipped"), "failed")


def _observed(seen: Observation) -> dict[str, int]:
    """What was counted; nothing where Spark found that part of the plan to be empty and dropped it."""
    try:
        return seen.get
    except Py4JJavaError as e:  # PySpark can't turn a row without columns into one of its own
        if "AssertionError" not in str(e.java_exception):
            raise
        return {}


def export_counted(records: DataFrame, write: Callable[[DataFrame], None], **options) -> dict[str, int]:
    """Export with ``write``, and count ``exported``, ``skipped`` and ``failed`` in that same run.

    ``write`` runs one action on the rows that it gets; ``options`` are those of :func:`export_job`.
    The rows are counted where they pass, so nothing is read again for it. Where Spark has dropped a
    part of the plan as empty, what was counted there is lost, and the log is counted by itself. A
    stage that is run anew because its shuffle files were lost counts its rows again: where that
    matters there is :func:`export_counts`.
    """
    read, done = Observation(), Observation()
    seen = records.observe(read, F.count_if("parse_ok").alias("good"), F.count_if(~F.col("parse_ok")).alias("failed"))
    write(export_job(seen, **options).observe(done, F.count("*").alias("exported")))
    exported, counts = _observed(done).get("exported", 0), _observed(read)
    if not counts:
        counts = records.agg(F.count_if("parse_ok").alias("good"), F.count_if(~F.col("parse_ok")).alias("failed")).first().asDict()
    return {"exported": exported, "skipped": counts["good"] - exported, "failed": counts["failed"]}


def stats_job(records: DataFrame, words: dict | None = None, start: str | None = None, end: str | None = None, top: int = 10, groups: Iterable[str] = ("user",), bucket: str | None = None, listing: DataFrame | None = None, skipped: DataFrame | None = None) -> dict[str, DataFrame]:
    """Sections by name: totals, slow, groups, and buckets if asked for.

    Files of ``listing`` that gave no line count as errors, those of ``skipped`` as skipped.
    """
    kept = records.filter("parse_ok").filter(stats_any(words or {}, start=start, end=end))
    out = {"totals": totals(records, listing, skipped), "slow": slowest(kept, top), "groups": group_sections(kept, [*groups])}
    if bucket:
        out["buckets"] = bucket_bars(buckets(kept, bucket))
    return out


def digest_job(records: DataFrame, start: str | None = None, end: str | None = None, by: str = "count", top: int | None = None, min_count: int = 1) -> DataFrame:
    """Ranked fingerprints of a time range."""
    return top_digest(digest(records.filter("parse_ok").filter(time_range(start, end)), min_count), by, top)


def export_new(kept: Incremental, write: Callable[[DataFrame], None], **options) -> dict[str, int]:
    """Export the files of a folder that are new or changed, and commit the manifest when ``write`` has returned.

    ``options`` are those of :func:`export_job`. A run that dies before the commit exports its files
    again, so ``write`` should replace what such a run may have left where that matters.
    """
    return kept.update(lambda records: write(export_job(records, **options)))


def digest_kept(kept: Incremental, by: str = "count", top: int | None = None, min_count: int = 1) -> DataFrame:
    """Ranked fingerprints of all files that the manifest names, from the parts kept for each."""
    return top_digest(digest_of(kept.read("digest"), min_count), by, top)


def stats_kept(kept: Incremental, bucket: str = "hour") -> dict[str, DataFrame]:
    """Totals by file from the manifest, and load by time from the parts kept for each file."""
    return {"files": kept.manifest.read().select("path", "records"), "buckets": bucket_bars(buckets_of(kept.read("minute"), bucket))}


def transactions_of(records: DataFrame, exec_ids: Iterable[int] = (), min_ms: float | None = None, min_rows: int | None = None, wanted: Iterable[str] = (), unwanted: Iterable[str] = ()) -> DataFrame:
    """All records of transactions with a slow, large, listed or textually matching record."""
    test = indicators(exec_ids, min_ms, min_rows)
    if [*wanted] or [*unwanted]:
        test |= txn_sql(wanted, unwanted)
    return retain_transactions(records, test)
