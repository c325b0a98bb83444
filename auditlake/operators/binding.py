"""Binding of parameter records to the statements that used them, as an as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.functions.text import bind, params, placeholders
from auditlake.schema import DML_TAGS
from auditlake.storage import written


#: Width of a slice of a file in places: bytes where a record's place is one, else numbers of records.
SLICE = 1 << 24


def _slice(records: DataFrame, width: int) -> Column:
    """The slice of its file that a record lies in: the block that was read, or a range of places."""
    if isinstance(records.schema["pos"].dataType, StructType):
        return F.col("pos.block")
    return F.floor(F.col("pos") / width)


def bind_params(records: DataFrame, style: str | None = None, width: int = SLICE) -> DataFrame:
    """Add ``normalized_sql``: statements with the values of the latest parameter record before them.

    A data statement with placeholders takes the last well-formed parameter record of its file,
    session and statement handle before it; later statements use it again until the next one. The
    number of values must equal the number of placeholders, else the result is null. Bind
    before filtering, so that parameter records count even if they are filtered out. ``style`` forces
    ``sequential`` or ``ordinal`` placeholders; the count is found by looking, as ever.

    Only parameter records and such statements pass a window, and that window spans a slice of a
    file (``width`` places, or the block that was read), however busy a session is. Each slice also
    yields its last parameter record; a scan over these, a row per slice, carries it to the slices
    after it, whose first statements take it. Records are written under ``spark.checkpoint.dir`` when
    this is called, since three branches read them, and gone when the application ends.
    """
    if style not in (None, "sequential", "ordinal"):
        raise ValueError(f"{style}: no such style")
    given = F.col("tag").isNull() & F.col("sql").startswith("PARAMS(")
    found = F.when(F.col("tag").isin(*DML_TAGS), placeholders(F.col("sql")))
    marked = records.withColumn("_p", F.explode(F.array(found))).withColumn("_given", F.coalesce(given, F.lit(False)))
    if not records.isStreaming:  # three branches read what is parsed and told apart here
        marked = written(marked, "bind")
    takes = F.coalesce(F.col("_p.n") > 0, F.lit(False))
    key = F.struct(*[F.col(c).alias(c) for c in ("file", "sess_id", "statement")])
    busy = marked.filter(takes | F.col("_given")).withColumns({"_key": key, "_slice": _slice(records, width), "_own": F.when(F.col("_given"), params(F.col("sql")))})
    # a row per slice: the last well-formed parameter record in it, and the one before it
    ends = busy.groupBy("_key", "_slice").agg(F.max(F.when(F.col("_own").isNotNull(), F.struct("pos", F.col("_own").alias("v")))).alias("_end"))
    earlier = Window.partitionBy("_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_key", "_slice", F.last("_end.v", ignorenulls=True).over(earlier).alias("_carried"))
    within = Window.partitionBy("_key", "_slice").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    busy = busy.withColumn("_latest", F.last("_own", ignorenulls=True).over(within)).join(carried, ["_key", "_slice"], "left").withColumn("_v", F.coalesce("_latest", "_carried"))
    ordinal = F.col("_p.ordinal") if style is None else F.lit(style == "ordinal")
    bound = F.when(takes & (F.size("_v") == F.col("_p.n")), bind(F.col("sql"), F.col("_v"), ordinal))
    rest = marked.filter(~(takes | F.col("_given"))).withColumn("normalized_sql", F.lit(None).cast("string"))
    return busy.withColumn("normalized_sql", bound).select(*records.columns, "normalized_sql").unionByName(rest.select(*records.columns, "normalized_sql"))
