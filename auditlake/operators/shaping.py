"""Shaping records for export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import strip_mapped_ip, whole_ms
from auditlake.schema import FIELDS, METRICS, ORDER
from auditlake.storage import shared_folder


def project(records: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """The named fields in the given order; none named means all. Unknown names are refused."""
    fields = [*(fields or FIELDS)]
    if unknown := [f for f in fields if f not in FIELDS]:
        raise ValueError(f"no such field: {', '.join(unknown)}")
    return records.select(*fields)


def export_rows(records: DataFrame, normalized: bool = True, metrics: bool = True, text_rule: bool = False, keep_order: bool = False) -> DataFrame:
    """Records as they are exported: plain addresses, whole milliseconds, metrics null where there are none.

    Metrics are null if time, rows and execution id are all zero or missing; with ``text_rule``
    rows don't count. ``normalized_sql`` is null where records have none.
    """
    ms = whole_ms(F.col("exec_time_ms"))
    some = (F.coalesce(ms, F.lit(0)) > 0) | (F.coalesce("exec_id", F.lit(0)) != 0)
    if not text_rule:
        some |= F.coalesce("row_count", F.lit(0)) != 0
    out = records.withColumns({"client_ip": strip_mapped_ip(F.col("client_ip")), "exec_time_ms": F.when(some, F.coalesce(ms, F.lit(0))), "row_count": F.when(some, F.coalesce("row_count", F.lit(0))), "exec_id": F.when(some, F.coalesce("exec_id", F.lit(0)))})
    if "normalized_sql" not in records.columns:
        out = out.withColumn("normalized_sql", F.lit(None).cast("string"))
    fields = [f for f in FIELDS if (metrics or f not in METRICS) and (normalized or f != "normalized_sql")]
    return out.select(*(ORDER if keep_order else ()), *fields)


def first_records(records: DataFrame, n: int) -> DataFrame:
    """The first records in file order."""
    return records.orderBy(*ORDER).limit(n)


def concatenate(parts: Sequence[DataFrame]) -> DataFrame:
    """Parts one below the other, columns by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_rank(df: DataFrame, *order: str | Column) -> DataFrame:
    """Add ``rank`` 1, 2, … in the given order, which should have no ties, without one task for all rows.

    Rows are dealt to ranges, sorted there and written once to the shared folder; a row's rank is its
    place in its range after the sizes of the ranges before, a number for each range.
    """
    place, path = F.monotonically_increasing_id(), shared_folder(df.sparkSession, "rank")
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place).write.parquet(path)
    rows = df.sparkSession.read.parquet(path).withColumns({"_range": F.shiftright("_place", 33), "_row": F.col("_place").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))  # a row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(base), "_range").select(*df.columns, (F.col("_base") + F.col("_row") + 1).alias("rank"))
