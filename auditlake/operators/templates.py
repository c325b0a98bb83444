"""Statistics of statement templates, and the data behind charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.text import bucket_high, bucket_low, label, micros, template


def observed(records: DataFrame) -> DataFrame:
    """Tagged records added up by template and duration, in one shuffle of partial sums.

    ``template_key, us, n, first_seen, last_seen``; such rows can be added up again across days.
    """
    keyed = records.filter(F.col("tag").isNotNull()).select(template(F.col("sql")).alias("template_key"), micros(F.col("exec_time_ms")).alias("us"), "ts")
    return keyed.groupBy("template_key", "us").agg(F.count("*").alias("n"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def merged(parts: list[DataFrame]) -> DataFrame:
    """Observations of several runs as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("template_key", "us").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def template_stats(seen: DataFrame, mode: str = "exact") -> DataFrame:
    """``template_key, count, avg_us, min_us, max_us, p50_us, p95_us, p99_us, first_seen, last_seen``.

    Percentiles are picked from running counts over the distinct durations of a template, which
    stay few however many records there are. ``mode="hdr"`` first rounds durations to two-digit
    histogram buckets, reporting the lowest value of the first and the highest of the others.
    """
    if mode == "hdr":
        seen = seen.groupBy("template_key", bucket_low(F.col("us")).alias("low"), bucket_high(F.col("us")).alias("us")).agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    else:
        seen = seen.withColumn("low", F.col("us"))
    key = Window.partitionBy("template_key")
    run = seen.withColumn("upto", F.sum("n").over(key.orderBy("us"))).withColumn("all", F.sum("n").over(key))
    pick = {f"p{q}_us": F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * F.lit(q) / 100), F.col("us"))).alias(f"p{q}_us") for q in (50, 95, 99)}
    middle = F.col("low") + F.floor((F.col("us") - F.col("low") + 1) / 2)
    out = run.groupBy("template_key").agg(F.sum("n").alias("count"), F.sum(F.col("n") * middle).alias("s"), F.min("low").alias("min_us"), F.max("us").alias("max_us"), *pick.values(), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return out.select("template_key", "count", F.floor(F.col("s") / F.col("count")).cast("long").alias("avg_us"), "min_us", "max_us", *pick, "first_seen", "last_seen")


def top_templates(stats: DataFrame, n: int = 10, size: int = 40) -> DataFrame:
    """The most frequent templates with short labels: ``template_key, label, count``."""
    return stats.select("template_key", label(F.col("template_key"), size).alias("label"), "count").orderBy(F.desc("count"), "template_key").limit(n)


def latency_histogram(seen: DataFrame, n: int = 10) -> DataFrame:
    """Histogram buckets of the most frequent templates: ``template_key, bucket_low, bucket_high, count``."""
    top = seen.groupBy("template_key").agg(F.sum("n").alias("count")).orderBy(F.desc("count"), "template_key").limit(n).select("template_key")
    kept = seen.join(top, "template_key", "left_semi")
    return kept.groupBy("template_key", bucket_low(F.col("us")).alias("bucket_low"), bucket_high(F.col("us")).alias("bucket_high")).agg(F.sum("n").alias("count"))


def template_count(seen: DataFrame) -> DataFrame:
    """One row: ``templates``."""
    return seen.agg(F.count_distinct("template_key").alias("templates"))


def hourly(records: DataFrame) -> DataFrame:
    """Tagged records by hour: ``hour, count``."""
    return records.filter(F.col("tag").isNotNull() & (F.length("ts") >= 13)).groupBy(F.substring("ts", 1, 13).alias("hour")).agg(F.count("*").alias("count"))


def trend_labels(trend: DataFrame) -> DataFrame:
    """Add ``label``: the hour, with the day if there are several days."""
    day = F.substring("hour", 1, 10)
    days = trend.agg((F.min(day) != F.max(day)).alias("_many"))  # one row
    hour = F.concat(F.substring("hour", 12, 2), F.lit(":00"))
    return trend.join(F.broadcast(days)).withColumn("label", F.when(F.col("_many"), F.concat(F.substring("hour", 6, 5), F.lit(" "), hour)).otherwise(hour)).drop("_many")


def user_counts(records: DataFrame) -> DataFrame:
    """Tagged records by user, without the empty one: ``username, count``."""
    return records.filter(F.col("tag").isNotNull() & (F.col("username") != "")).groupBy("username").agg(F.count("*").alias("count"))


def user_share(counts: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` users and ``Others``, with their share in percent: ``slice, count, share, rest``.

    ``rest`` is true for the slice of all others, as a user may be called ``Others`` too.
    """
    top = counts.orderBy(F.desc("count"), "username").limit(n)
    whole = counts.agg(F.sum("count").alias("_all"))  # one row
    others = top.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("_top")).join(whole).select(F.lit("Others").alias("slice"), (F.col("_all") - F.col("_top")).alias("count"), F.lit(True).alias("rest"))
    sliced = top.select(F.col("username").alias("slice"), "count", F.lit(False).alias("rest")).unionByName(others).filter(F.col("count") > 0)
    return sliced.join(F.broadcast(whole)).withColumn("share", 100 * F.col("count") / F.col("_all")).drop("_all")
