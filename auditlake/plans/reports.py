"""Reports: a summary row and its sections, and the same as lines of JSON."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.filters import time_range
from auditlake.operators.shaping import concatenate
from auditlake.operators.stats import digest, per_file, top_digest, totals
from auditlake.plans.jobs import stats_job
from auditlake.storage import shared_folder


def digest_report(records: DataFrame, by: str = "count", top: int | None = None, min_count: int = 1, start: str | None = None, end: str | None = None, listing: DataFrame | None = None, skipped: DataFrame | None = None) -> dict[str, DataFrame]:
    """``summary`` (files, records, errors, skipped, ``fingerprints`` before the cut at ``top`` and ``shown`` after it) and ``entries``.

    The digest, a row for each fingerprint, is written once to the shared folder; both counts and the
    entries are read from there.
    """
    spark, path = records.sparkSession, shared_folder(records.sparkSession, "digest")
    digest(records.filter("parse_ok").filter(time_range(start, end)), min_count).write.parquet(path)
    kept = spark.read.parquet(path)
    counts = kept.agg(F.count("*").alias("fingerprints")).withColumn("shown", F.least("fingerprints", F.lit(top).cast("long")) if top else F.col("fingerprints"))
    return {"summary": totals(records, listing, skipped).join(F.broadcast(counts)), "entries": top_digest(kept, by, top)}


def stats_report(records: DataFrame, listing: DataFrame | None = None, skipped: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """``summary``, ``per_file`` where a listing is given, and the sections of :func:`auditlake.plans.jobs.stats_job`, whose options these are."""
    out = stats_job(records, listing=listing, skipped=skipped, **options)
    files = {} if listing is None else {"per_file": per_file(records, listing)}
    return {"summary": out.pop("totals"), **files, **out}


def json_lines(report: Mapping[str, DataFrame]) -> DataFrame:
    """One line of JSON for each row of a report, the name of its section first; null fields are kept."""
    rows = [df.select(F.lit(name).alias("section"), *df.columns) for name, df in report.items()]
    return concatenate([r.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")) for r in rows])
