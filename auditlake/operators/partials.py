"""Aggregates kept per file, and what is read from them: digests, templates, load by time, files to skip."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions.text import fingerprint, micros, snippet, template
from auditlake.operators.stats import BUCKETS


def _ms() -> Column:
    return F.coalesce("exec_time_ms", F.lit(0.0))


def digest_part(records: DataFrame) -> DataFrame:
    """Load by file and fingerprint, with the first record of each."""
    keyed = records.filter("parse_ok").select("path", fingerprint(F.col("sql")).alias("fingerprint"), snippet(F.col("sql")).alias("sql"), "ts", "file", "pos", "exec_time_ms")
    first = F.min(F.struct(F.struct("file", "pos").alias("at"), "sql", "ts")).alias("first")
    return keyed.groupBy("path", "fingerprint").agg(F.count("*").alias("count"), F.sum(_ms()).alias("total_ms"), F.max(_ms()).alias("max_ms"), first)


def digest_of(parts: DataFrame, min_count: int = 1) -> DataFrame:
    """The digest of all files, as of their records."""
    out = parts.groupBy("fingerprint").agg(F.sum("count").alias("count"), F.sum("total_ms").alias("total_ms"), F.max("max_ms").alias("max_ms"), F.min("first").alias("first"))
    named = out.select("fingerprint", "count", "total_ms", "max_ms", F.col("first.sql").alias("example"), F.col("first.ts").alias("first_seen"), (F.col("total_ms") / F.col("count")).alias("avg_ms"))
    return named.filter(F.col("count") >= min_count)


def template_part(records: DataFrame) -> DataFrame:
    """Tagged records by file, template and duration; :func:`auditlake.operators.templates.merged` adds them up."""
    keyed = records.filter("parse_ok AND tag IS NOT NULL").select("path", template(F.col("sql")).alias("template_key"), micros(F.col("exec_time_ms")).alias("us"), "ts")
    return keyed.groupBy("path", "template_key", "us").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def minute_part(records: DataFrame) -> DataFrame:
    """Load by file and minute."""
    minute = F.substring("ts", 1, BUCKETS["minute"]).alias("minute")
    return records.filter("parse_ok").groupBy("path", minute).agg(F.count("*").alias("count"), F.sum(_ms()).alias("total_ms"), F.max(_ms()).alias("max_ms"))


def buckets_of(parts: DataFrame, by: str = "hour") -> DataFrame:
    """Load by hour or minute of all files."""
    out = parts.groupBy(F.substring("minute", 1, BUCKETS[by]).alias("bucket")).agg(F.sum("count").alias("count"), F.sum("total_ms").alias("total_ms"), F.max("max_ms").alias("max_ms"))
    return out.select("bucket", "count", "total_ms", (F.col("total_ms") / F.col("count")).alias("avg_ms"), "max_ms")


#: Maps of bits of a file, each of 32768 bits: a transaction sets one bit of one map.
MAPS = 64


def _bit(trx: Column) -> tuple[Column, Column]:
    h = F.xxhash64(trx)
    return F.pmod(h, F.lit(MAPS)).cast("int"), F.pmod(F.shiftrightunsigned(h, 6), F.lit(32768)).cast("int")


def zone_part(records: DataFrame) -> DataFrame:
    """A zone map of each file and each of its maps of transaction ids: ``path, map, low, high, bits``.

    ``low`` and ``high`` are the least and the largest time among the records of that map.
    """
    number, bit = _bit(F.col("trx_id"))
    keyed = records.filter("parse_ok").select("path", "ts", number.alias("map"), (bit + 1).alias("bit"))
    return keyed.groupBy("path", "map").agg(F.min("ts").alias("low"), F.max("ts").alias("high"), F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))


def files_with(zones: DataFrame, start: str | None = None, end: str | None = None, trx_ids: Iterable[str] | None = None) -> DataFrame:
    """Paths of files that may hold records of a time range and of some of the given transactions.

    Times are compared as :func:`auditlake.operators.filters.time_range` does. No file that holds
    such a record is missing; one that holds none may be there by chance of a shared bit.
    """
    keep = F.lit(True)
    if start:
        keep &= (F.col("high") >= start) | F.col("high").startswith(start)
    if end:
        keep &= (F.col("low") <= end) | F.col("low").startswith(end)
    if trx_ids is not None:
        ids = zones.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(trx_ids)], "trx string")
        number, bit = _bit(F.col("trx"))
        wanted = ids.select(number.alias("map"), bit.alias("bit"))
        byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = zones.filter(keep).join(wanted, "map")
        return found.filter(F.getbit(byte.cast("long"), F.col("bit") % 8) == 1).select("path").distinct()
    return zones.filter(keep).select("path").distinct()


#: Parts of the log analysis by name.
PARTS = {"digest": digest_part, "template": template_part, "minute": minute_part, "zone": zone_part}
