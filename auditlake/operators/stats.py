"""Statistics: totals, groups, time buckets, slow statements, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import fingerprint, snippet
from auditlake.operators.shaping import with_rank

#: Grouping fields by the name they are asked for.
GROUPS = {"user": "username", "app": "appname", "ip": "client_ip"}
#: Length of the text prefix of a time that makes a bucket.
BUCKETS = {"hour": 13, "minute": 16}


def _ms() -> Column:
    return F.coalesce("exec_time_ms", F.lit(0.0))


def _load() -> list[Column]:
    return [F.count("*").alias("count"), F.sum(_ms()).alias("total_ms"), (F.sum(_ms()) / F.count("*")).alias("avg_ms"), F.max(_ms()).alias("max_ms")]


def totals(records: DataFrame, listing: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """One row: ``files, records, errors, skipped``.

    ``skipped`` has a row per file that was left out as done before. With ``listing(file, size)`` of
    the files to be read, one that holds something but gave no line was unreadable: an error each.
    """
    by = records.groupBy("file").agg(F.count_if("parse_ok").alias("good"), F.count_if(~F.col("parse_ok")).alias("bad"))
    lost = F.lit(False)
    if listing is not None:  # one read of the log: files without a line come in by the join
        by = by.join(listing.filter("size > 0").select("file", F.lit(True).alias("listed")).distinct(), "file", "full")
        lost = F.col("listed") & F.col("good").isNull()
    count = lambda x: F.coalesce(F.sum(x), F.lit(0).cast("long"))
    out = by.agg(F.count_if(F.col("good").isNotNull()).alias("files"), count("good").alias("records"), (count("bad") + F.count_if(lost)).alias("errors"))
    if skipped is None:
        return out.withColumn("skipped", F.lit(0).cast("long"))
    return out.join(F.broadcast(skipped.agg(F.count("*").alias("skipped"))))


def per_file(records: DataFrame, listing: DataFrame) -> DataFrame:
    """``file, records, errors`` of every file of ``listing(file)``, empty ones included."""
    counted = records.groupBy("file").agg(F.count_if("parse_ok").alias("records"), F.count_if(~F.col("parse_ok")).alias("errors"))
    return listing.select("file").distinct().join(counted, "file", "left").na.fill(0, ["records", "errors"])


def group_by(records: DataFrame, by: str) -> DataFrame:
    """Load by user, app or ip: ``key, count, total_ms, avg_ms, max_ms``; records without metrics count with 0."""
    if by not in GROUPS:
        raise ValueError(f"{by}: no such grouping")
    key = F.col(GROUPS[by])
    return records.groupBy(F.when(F.length(key) == 0, "(unknown)").otherwise(key).alias("key")).agg(*_load())


def group_sections(records: DataFrame, by: Sequence[str]) -> DataFrame:
    """Independent sections in one pass: the columns of :func:`group_by` and ``section``."""
    names = [*dict.fromkeys(by)]
    if unknown := [n for n in names if n not in GROUPS]:
        raise ValueError(f"no such grouping: {', '.join(unknown)}")
    keyed = records.select(_ms().alias("exec_time_ms"), F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.when(F.length(GROUPS[n]) == 0, "(unknown)").otherwise(F.col(GROUPS[n])).alias("key")) for n in names])).alias("g"))
    return keyed.groupBy("g.section", "g.key").agg(*_load())


def buckets(records: DataFrame, by: str = "hour") -> DataFrame:
    """Load by hour or minute, the time's text prefix; buckets without records don't appear."""
    return records.groupBy(F.substring("ts", 1, BUCKETS[by]).alias("bucket")).agg(*_load())


def bucket_bars(bucketed: DataFrame, width: int = 20) -> DataFrame:
    """Add ``bar``: the bucket's count in proportion to the largest one, in blocks."""
    most = bucketed.agg(F.max("count").alias("_most"))  # one row
    size = F.floor(F.col("count") * width / F.col("_most"))
    return bucketed.join(F.broadcast(most)).withColumn("bar_len", size.cast("long")).drop("_most").withColumn("bar", F.expr("repeat('█', cast(bar_len as int))"))


def slowest(records: DataFrame, n: int = 10) -> DataFrame:
    """The slowest records with metrics: ``rank, exec_time_ms, ts, sql, file``, ties by time, file and place."""
    order = [F.desc("exec_time_ms"), F.asc("ts"), F.asc("file"), F.asc("pos")]
    top = records.filter(F.col("exec_time_ms").isNotNull()).select("exec_time_ms", "ts", snippet(F.col("sql")).alias("sql"), "file", "pos").orderBy(*order).limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("pos")


def digest(records: DataFrame, min_count: int = 1) -> DataFrame:
    """Load by fingerprint: the load columns, and the text and time of the first record in file order.

    The fingerprint is taken where records are read, so one shuffle carries partial sums of
    fingerprints, however many statements differ in their literals.
    """
    first = F.struct("file", "pos")
    keyed = records.select(fingerprint(F.col("sql")).alias("fingerprint"), snippet(F.col("sql")).alias("sql"), "ts", "file", "pos", "exec_time_ms")
    out = keyed.groupBy("fingerprint").agg(F.count("*").alias("count"), F.sum(_ms()).alias("total_ms"), F.max(_ms()).alias("max_ms"), F.min(F.struct(first.alias("at"), "sql", "ts")).alias("first"))
    named = out.select("fingerprint", "count", "total_ms", "max_ms", F.col("first.sql").alias("example"), F.col("first.ts").alias("first_seen"), (F.col("total_ms") / F.col("count")).alias("avg_ms"))
    return named.filter(F.col("count") >= min_count)


def top_digest(digested: DataFrame, by: str = "count", n: int | None = None) -> DataFrame:
    """Digest rows ranked by ``count`` or ``exec`` (total time), the first ``n``; all of them are ranked range by range."""
    order = [F.desc({"count": "count", "exec": "total_ms"}[by]), F.asc("fingerprint")]
    if not n:
        return with_rank(digested, *order)
    return digested.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))
