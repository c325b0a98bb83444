"""Structured Streaming over log files: ingest, bucket statistics and a running digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.text import fingerprint, snippet
from auditlake.sources.logs import parse_sqllog


def stream_records(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Records of the ``*.log`` files of a folder as they arrive; single-line records only."""
    reader = spark.readStream.option("pathGlobFilter", "*.log")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    lines = reader.text(folder).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.lit(0).cast("long").alias("pos"), "value")
    return parse_sqllog(lines).drop("pos").withColumn("ts_time", F.try_to_timestamp("ts", F.lit("yyyy-MM-dd HH:mm:ss.SSS")))


def stream_buckets(records: DataFrame, width: str = "1 hour", late: str = "365 days") -> DataFrame:
    """Load by tumbling window; records later than ``late`` behind the newest one no longer count."""
    ms = F.coalesce("exec_time_ms", F.lit(0.0))
    by = records.filter("parse_ok").withWatermark("ts_time", late).groupBy(F.window("ts_time", width).alias("w"))
    out = by.agg(F.count("*").alias("count"), F.sum(ms).alias("total_ms"), F.max(ms).alias("max_ms"))
    return out.select(F.col("w.start").alias("start"), "count", "total_ms", "max_ms")


def stream_digest(records: DataFrame) -> DataFrame:
    """Running load by fingerprint; the example is that of the earliest time."""
    ms = F.coalesce("exec_time_ms", F.lit(0.0))
    keyed = records.filter("parse_ok").withColumn("fingerprint", fingerprint(F.col("sql")))
    return keyed.groupBy("fingerprint").agg(F.count("*").alias("count"), F.sum(ms).alias("total_ms"), F.min("ts").alias("first_seen"), F.min_by(snippet(F.col("sql")), F.struct("ts", "sql")).alias("example"))


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Work off what is there now into the Parquet table in folder ``name``, and return it; in complete mode each batch replaces the table."""
    query = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "complete":
        df.sparkSession.createDataFrame([], df.schema).write.mode("ignore").parquet(name)  # there may be no batch
        query.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(name)).start().awaitTermination()
    else:
        query.format("parquet").option("path", name).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(name)
