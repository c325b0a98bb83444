"""A versioned manifest of log files done, and results kept per file, with one atomic commit for both."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.operators.filters import by_trx_ids, time_range
from auditlake.operators.partials import files_with
from auditlake.sources.logs import list_logs, parse_sqllog, scan_files
from auditlake.storage import move_new, remove_folder, stat_files

#: A row for each file: what it was when it was read, how many records it gave, when, and the batch that holds its partial results.
SCHEMA = "path string, size long, mtime long, records long, processed_at timestamp, batch string"


class Conflict(RuntimeError):
    """Other writers committed again and again."""


class Manifest:
    """Versions of a manifest in a folder that driver and executors share.

    A version is a folder of Parquet files, written under a name of its own and then renamed to the
    next number. The rename fails where that number is taken, so of two writers one wins; the other
    reads the new version and tries again. Readers see whole versions only.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def version(self) -> int:
        """Number of the latest version, 0 before the first."""
        names = [n for n, *_ in stat_files(self.spark, self.folder, "v-*")]
        return max((int(n[2:]) for n in names), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The manifest as of a version, by default the latest."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/v-{version:012d}")

    def commit(self, change: Callable[[DataFrame], DataFrame], tries: int = 10) -> int:
        """Make ``change(manifest)`` the next version; the change is made again where another writer was first."""
        for _ in range(tries):
            base = self.version()
            temporary = f"{self.folder}/_new-{uuid.uuid4().hex}"
            change(self.read(base)).select("path", "size", "mtime", "records", "processed_at", "batch").write.parquet(temporary)
            if move_new(self.spark, temporary, f"{self.folder}/v-{base + 1:012d}"):
                return base + 1
        raise Conflict(f"{self.folder}: other writers were first {tries} times")


def plain_path(path: Column) -> Column:
    """A path in one spelling: as it is listed, or decoded from the address that a read reports."""
    return F.regexp_replace(path, r"^([A-Za-z0-9+.-]+):/+", "$1:/")


def pending(listing: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files to be read, and files that are in the manifest as they are now, by path, size and time."""
    same = manifest.select("path", "size", "mtime").distinct()
    return listing.join(same, ["path", "size", "mtime"], "left_anti"), listing.join(same, ["path", "size", "mtime"], "left_semi")


class Incremental:
    """Logs of a folder, read once, with results that stay right when files come, change and go.

    ``parts`` makes, from parsed records with their ``path``, tables whose rows belong to one file each
    (partial aggregates by path, for instance). :meth:`update` reads only files that are new or
    changed, writes their parts under a batch of its own, and then commits the manifest that names
    the batch: one atomic step. If it dies before, no reader sees anything and the files are read
    again; after it, none is. A file that changed has its old parts retracted, as the manifest names
    another batch for it, and so has a file that is gone.
    """

    def __init__(self, spark: SparkSession, logs: str, folder: str, parts: Mapping[str, Callable[[DataFrame], DataFrame]], tolerant: bool = False):
        self.spark, self.logs, self.folder, self.parts, self.tolerant = spark, logs, folder.rstrip("/"), dict(parts), tolerant
        self.manifest = Manifest(spark, f"{self.folder}/manifest")

    def _records(self, paths: list[str]) -> DataFrame:
        lines = scan_files(self.spark, paths, self.tolerant)
        address = F.replace("path", F.lit("+"), F.lit("%2B"))  # only %-codes are to be decoded
        return parse_sqllog(lines.withColumn("path", plain_path(F.url_decode(address))), keep=("path",))

    def listing(self) -> DataFrame:
        """Files that are there now."""
        return list_logs(self.spark, self.logs).withColumn("path", plain_path(F.col("path")))

    def update(self, action: Callable[[DataFrame], None] | None = None) -> dict[str, int]:
        """Read what is new; returns numbers of files ``read, skipped, removed`` and the ``version`` of the manifest.

        ``action`` gets the new records before the commit: an export, say. If it fails, nothing is
        committed.
        """
        seen = self.manifest.read()
        listing = self.listing()
        todo, kept = pending(listing, seen)
        files = todo.select("file", "path", "size", "mtime").collect()  # Spark lists the files of a read on the driver as well
        gone = seen.select("path").distinct().join(listing.select("path"), "path", "left_anti")
        out = {"read": len(files), "skipped": kept.count(), "removed": gone.count()}
        if not files and not out["removed"]:
            return out | {"version": self.manifest.version()}
        batch = uuid.uuid4().hex
        done = self.spark.createDataFrame(files, "file string, path string, size long, mtime long").drop("file")
        counted = self.spark.createDataFrame([], "path string, records long")
        if files:
            records = self._records([f["path"] for f in files])
            if action is not None:
                action(records)
            # the text is parsed once, all parts are made from the records
            records.write.parquet(f"{self.folder}/_parsed/{batch}")
            parsed = self.spark.read.schema(records.schema).parquet(f"{self.folder}/_parsed/{batch}")
            try:
                for name, part in {**self.parts, "_records": _counted}.items():
                    part(parsed).write.parquet(f"{self.folder}/{name}/{batch}")
            finally:
                remove_folder(self.spark, f"{self.folder}/_parsed/{batch}")
            counted = self.spark.read.parquet(f"{self.folder}/_records/{batch}")
        rows = done.join(counted, "path", "left").select("path", "size", "mtime", F.coalesce("records", F.lit(0).cast("long")).alias("records"), F.current_timestamp().alias("processed_at"), F.lit(batch).alias("batch"))

        def change(manifest: DataFrame) -> DataFrame:
            replaced = rows.select("path").unionByName(gone).distinct()
            return manifest.join(replaced, "path", "left_anti").select(*rows.columns).unionByName(rows)

        return out | {"version": self.manifest.commit(change)}

    def records(self, start: str | None = None, end: str | None = None, trx_ids: list[str] | None = None) -> DataFrame:
        """Records of a time range and of transactions: files whose zone maps exclude them are not opened.

        Needs the part ``zone``. Files that are not in the manifest as they are now are read too.
        """
        todo, kept = pending(self.listing(), self.manifest.read())
        found = files_with(self.read("zone"), start, end, trx_ids)
        paths = [r["path"] for r in todo.select("path").unionByName(kept.join(found, "path", "left_semi").select("path")).collect()]
        if not paths:
            return parse_sqllog(self.spark.createDataFrame([], "file string, path string, pos struct<block:long,row:long>, value string"), keep=("path",))
        records = self._records(paths).filter(time_range(start, end))
        return records if trx_ids is None else by_trx_ids(records, trx_ids)

    def read(self, name: str) -> DataFrame:
        """Parts of all files that the manifest names, each from the batch it was last read in."""
        current = self.manifest.read().select("path", "batch")
        batches = [r["batch"] for r in current.select("batch").distinct().collect()]  # one a run
        if not batches:
            raise ValueError(f"{self.folder}: nothing was read yet")
        found = self.spark.read.parquet(*[f"{self.folder}/{name}/{b}" for b in batches if stat_files(self.spark, f"{self.folder}/{name}", b)])
        named = found.withColumn("batch", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        return named.join(current, ["path", "batch"], "left_semi").drop("batch")


def _counted(records: DataFrame) -> DataFrame:
    return records.groupBy("path").agg(F.count_if("parse_ok").alias("records"))
