"""Pieces that several operators of this subpackage share: scratch tables, word hashing, components."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Words whose hashes a Python worker remembers at most; beyond it the memory starts anew.
HASH_CACHE = 600_000
#: Rows of an Arrow batch at most: texts and sets are long, and a batch is held in memory.
BATCH_ROWS = 1000
#: Buckets of a table at most. Beyond it a bucket holds several groups, read one after the other.
BUCKETS = 20_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and the master is local (tests), a new folder under the temporary folder is
    set as the context's checkpoint folder and used from then on; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir: name a folder there that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-", dir=tempfile.gettempdir()))
        found = spark.sparkContext.getCheckpointDir()
    return found


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    at = Path(os.path.realpath(tempfile.mkdtemp(prefix="spark-"))) / f"{top.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(at))
    _shipped.add(context.applicationId)


_shipped: set[str] = set()


class Scratch:
    """Tables written to the shared folder, so that lost executors never lose a finished step.

    A written table also forgets how its rows were partitioned, which lets adaptive execution
    split the hot keys of the joins that follow. The shuffle files of a step go as soon as it is
    written; tables that are still there when the application ends go then. Rows of Arrow batches
    are bounded by ``BATCH_ROWS`` for the session, as results are computed when they are read.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        path, files = self._at(self.root)
        files.deleteOnExit(path)
        self.paths: dict[int, str] = {}
        self.tables: list[DataFrame] = []  # so that no number of a table is used twice
        self.n = 0

    @contextmanager
    def _cleaned(self) -> Iterator[None]:
        """Shuffle files of what is executed here are deleted at its end."""
        name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = self.spark.conf.get(name, None)
        self.spark.conf.set(name, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(name)
            else:
                self.spark.conf.set(name, before)

    def _new(self) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}"

    def _known(self, out: DataFrame, path: str) -> DataFrame:
        self.paths[id(out)] = path
        self.tables.append(out)
        return out

    def cut(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once and return a reader of what was written."""
        path = self._new()
        with self._cleaned():
            df.write.parquet(path)
        return self._known(self.spark.read.schema(df.schema).parquet(path), path)

    def bucketed(self, df: DataFrame, column: str, buckets: int) -> DataFrame:
        """As ``cut``, in buckets of ``column``, ``BUCKETS`` at most: grouping by it needs no shuffle.

        Where that bound is met, rows are dealt to the buckets before they are written, one file each.
        """
        if buckets > BUCKETS:
            df, buckets = df.repartition(BUCKETS, column), BUCKETS
        path, name = self._new(), f"scratch_{uuid.uuid4().hex}"
        with self._cleaned():
            df.write.bucketBy(buckets, column).sortBy(column).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name only, the files are not the catalog's
        return self._known(out, path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for t in tables:
            self._delete(self.paths.pop(id(t)))

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        kept = {id(t): self.paths[id(t)] for t in tables}
        for path in set(self.paths.values()) - set(kept.values()):
            self._delete(path)
        self.paths = kept

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _delete(self, name: str) -> None:
        path, files = self._at(name)
        files.delete(path, True)


def local_path(path: str) -> str:
    """The mounted path behind a ``file:`` address; other stores cannot be memory-mapped."""
    if "://" not in path and not path.startswith("file:"):
        return path
    if not path.startswith("file:"):
        raise ValueError(f"{path}: a mounted folder that driver and executors share is needed here")
    return "/" + path[5:].lstrip("/")


def split_words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered; bytes methods touch ASCII only, which is the rule."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= HASH_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.full(n, 0x9E3779B97F4A7C15 * k % 2**64, np.uint64)
    for j in range(k):
        acc = mix(acc ^ h[j : j + n]) + np.uint64(0x9E3779B97F4A7C15)
    return acc


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; a shorter text is one shingle, an empty one none."""
    h = word_hashes(split_words(text))
    return np.unique(gram_hashes(h, min(k, len(h)))) if len(h) else np.empty(0, np.uint64)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows each."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, component)``, the component being its smallest id.

    Each round maps every node to the first one, in the round's order, among itself and its
    neighbours, and contracts the edges along that map. The image of a connected graph stays
    connected, so a round never loses a link. The first round goes by id, which contracts stars
    around their smallest node; the others go by a hash of id and round, so that whatever the
    ids, a chain halves in a round on average. The maps are followed one after the other at the end.
    Only nodes with an edge are returned. An empty input gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    e = scratch.cut(edges.filter("a <> b").select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    maps: list[DataFrame] = []
    while not e.isEmpty():
        rank = (lambda c: F.struct(c)) if not maps else (lambda c, r=len(maps): F.struct(F.xxhash64(c, F.lit(r)), c))
        both = e.unionByName(e.select(b.alias("a"), a.alias("b")))
        first = both.groupBy(a.alias("id")).agg(F.min(F.struct(rank(b).alias("r"), b.alias("to"))).alias("m"))
        near = scratch.cut(first.select("id", F.when(F.col("m.r") < rank(F.col("id")), F.col("m.to")).otherwise(F.col("id")).alias("to")))
        na, nb = near.select(F.col("id").alias("a"), F.col("to").alias("ta")), near.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        moved = scratch.cut(e.join(na, "a").join(nb, "b").filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        scratch.drop(e)
        e = moved
        maps.append(near)
    if not maps:
        return scratch.cut(e.select(a.alias("id"), a.alias("component")))
    scratch.drop(e)
    # the later a map, the fewer nodes it has
    while len(maps) > 1:
        last, near = maps.pop(), maps.pop()
        followed = near.join(last.select(F.col("id").alias("to"), F.col("to").alias("end")), "to", "left").select("id", F.coalesce("end", "to").alias("to"))
        maps.append(scratch.cut(followed))
        scratch.drop(last, near)
    names = maps[0].groupBy("to").agg(F.least(F.min("id"), F.col("to")).alias("component"))
    labels = scratch.cut(maps[0].join(names, "to").select("id", "component"))
    scratch.drop(maps[0])
    return labels
