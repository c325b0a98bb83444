"""Log files: listing, reading, decoding, assembling and parsing records, and the manifest of files done."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.storage import is_folder, stat_files

#: A record. The groups are time, endpoint, session, thread, user, transaction, statement,
#: application, address, tag, text, milliseconds, rows, execution id.
_HEAD = (
    r"(?s)\A(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d+) \(EP\[(\d+)\] sess:(\S*) (?:thrd:(\S*) )?user:(.*?) trxid:(\S*) stmt:(\S*)"
    r" appname:(.*?) ip:(\S*?)\) (?:\[([A-Z]+)\] )?(.*?)"
)
_TAIL = r"EXECTIME: ([0-9.]+)\(ms\) ROWCOUNT: (\d+)\(rows\) EXEC_ID: (\d+)\.?"
RECORD = rf"{_HEAD}(?:\.? *{_TAIL})?\s*\z"
#: The same for records with long runs of blanks, each looked through once: a statement that is not empty never ends behind a blank, but before a dot.
BLANKS = rf"{_HEAD}(?![^.\sE])(?:(?:\. *+|(?:(?<! )|(?<=[)\]] )) *+){_TAIL}\s*+|(?:(?<!\s)|(?<=[)\]] ))\s*+)\z"
#: What the first line of a record looks like.
HEADER = r"\A\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d+ \(EP\["
_MARK = "\x01"


def _lines(spark: SparkSession, path: str, tolerant: bool) -> DataFrame:
    reader = spark.read.option("ignoreCorruptFiles", tolerant).option("ignoreMissingFiles", tolerant)
    one = not any(c in path for c in "*?[") and not is_folder(spark, path)
    return _placed(reader.text(path) if one else reader.option("pathGlobFilter", "*.log").text(path))


def _placed(lines: DataFrame) -> DataFrame:
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), place.alias("pos"), "value")


def scan_logs(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Lines of a log file, of the ``*.log`` files of a folder, or of those that a pattern names.

    Columns ``file`` (name), ``path``, ``pos`` (order within the file) and ``value``. A missing path
    is an error; a folder without logs gives no rows. ``tolerant`` skips unreadable or vanished
    files, as statistics may; an export should not.
    """
    return _lines(spark, path, tolerant)


def scan_files(spark: SparkSession, paths: list[str], tolerant: bool = False) -> DataFrame:
    """Lines of the named files and of no others; columns of :func:`scan_logs`."""
    reader = spark.read.option("ignoreCorruptFiles", tolerant).option("ignoreMissingFiles", tolerant)
    return _placed(reader.text(paths))


def list_logs(spark: SparkSession, path: str) -> DataFrame:
    """``file, path, size, mtime`` (milliseconds) of the log files of a folder, empty ones included."""
    return spark.createDataFrame(stat_files(spark, path, "*.log"), "file string, path string, size long, mtime long")


def decode_gb18030(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Lines of GB18030 logs as text: arguments and columns of :func:`scan_logs`, blank lines included.

    No byte of a GB18030 character is a line end, so lines are split before they are decoded. Bytes
    that form no valid text become replacement characters.
    """
    lines = _lines(spark, path, tolerant)
    # Spark decodes by this name only with its older rules, which a column takes on when it is made
    rules = {n: spark.conf.get(n, None) for n in ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")}
    try:
        for n in rules:
            spark.conf.set(n, "true")
        return lines.withColumn("value", F.decode(F.col("value").cast("binary"), "GB18030"))
    finally:
        for n, v in rules.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def assemble(lines: DataFrame) -> DataFrame:
    """Join the lines of records that span several; ``lines(file, pos, value)``.

    A line that starts no record belongs to the record before it in its file. Lines before the
    first record of a file stay single and will not parse. Only files with such lines pass the
    window; the others keep their rows as they are.
    """
    starts = F.col("value").rlike(HEADER)
    marked = lines.select("file", "pos", "value", starts.alias("starts"))
    broken = marked.groupBy("file").agg(F.bool_and("starts").alias("whole")).filter(~F.col("whole")).select("file")
    whole = marked.join(broken, "file", "left_anti").select("file", "pos", "value")
    by_file = Window.partitionBy("file").orderBy("pos")
    split = marked.join(broken, "file", "left_semi").withColumn("record", F.sum(F.col("starts").cast("long")).over(by_file))
    split = split.withColumn("single", F.when(F.col("record") == 0, F.row_number().over(by_file)))
    parts = F.array_sort(F.collect_list(F.struct("pos", "value")))
    joined = split.groupBy("file", "record", "single").agg(parts.alias("p"))
    return whole.unionByName(joined.select("file", F.col("p")[0]["pos"].alias("pos"), F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value")))


def parse_sqllog(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Records of ``lines(file, pos, value)``: the log fields, typed, ``parse_ok``, and the columns of lines named in ``keep``.

    One pass of the pattern lays the groups out in a fixed order, the statement last, and a split
    takes them apart; a line that does not match has a single part, ``parse_ok`` false and null
    fields. Metrics are null where the tail is missing, and so are numbers that overflow.
    """
    order = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, 11)
    spread = [F.regexp_replace("value", pattern, _MARK.join(f"${i}" for i in order)) for pattern in (BLANKS, RECORD)]
    laid = F.split(F.when(F.col("value").rlike(r"\s{16}"), spread[0]).otherwise(spread[1]), _MARK, len(order))
    # behind a generator the pattern runs once a row, whatever is filtered or selected above it
    rows = lines.withColumn("_f", F.explode(F.array(laid))).withColumn("parse_ok", F.coalesce(F.size("_f") == len(order), F.lit(False)))

    def part(i: int) -> Column:
        return F.when(F.col("parse_ok"), F.try_element_at("_f", F.lit(i)))

    def number(i: int, kind: str) -> Column:
        return part(i).try_cast(kind)

    return rows.select(
        "file", "pos",
        part(1).alias("ts"), number(2, "int").alias("ep"), part(3).alias("sess_id"), part(4).alias("thrd_id"), part(5).alias("username"),
        part(6).alias("trx_id"), part(7).alias("statement"), part(8).alias("appname"), part(9).alias("client_ip"),
        F.nullif(part(10), F.lit("")).alias("tag"), part(14).alias("sql"),
        number(11, "float").cast("double").alias("exec_time_ms"), number(12, "long").alias("row_count"), number(13, "long").alias("exec_id"),
        "parse_ok", *keep,
    )


def new_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose path, size and time are not all as in the manifest."""
    return listing.join(manifest.select("path", "size", "mtime").distinct(), ["path", "size", "mtime"], "left_anti")


def skipped_files(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that the manifest says are done."""
    return listing.join(manifest.select("path", "size", "mtime").distinct(), ["path", "size", "mtime"], "left_semi")


def mark_done(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """The manifest with the rows of ``done`` in place of those of the same paths."""
    return manifest.join(done.select("path").distinct(), "path", "left_anti").select(*manifest.columns).unionByName(done.select(*manifest.columns))
