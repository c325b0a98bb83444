"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; where that is unset, under a temporary folder if the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir: name a folder there that driver and executors share")
    return f"{root or 'file://' + tempfile.mkdtemp(prefix='spark-')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a new folder under ``spark.checkpoint.dir`` and read from there; the folder goes when the application ends."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def rename(spark: SparkSession, moves: list[tuple[str, str]]) -> None:
    """Rename files within one store."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for old, new in moves:
        path(old).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(old), path(new))


def remove(spark: SparkSession, names: list[str]) -> None:
    """Delete files that are there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in names:
        path(name).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(name), False)


def remove_folder(spark: SparkSession, name: str) -> None:
    """Delete a folder with all that is in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_files(spark: SparkSession, joined: list[tuple[list[str], str]]) -> None:
    """Write files one behind the other into a new one: ``(files, new)`` each, a task for each new file."""
    from auditlake.sources import blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b["id"].to_pylist():
                store, new = blocks._opened(joined[i][1])
                with store.open_output_stream(new) as out:
                    for name in joined[i][0]:
                        with store.open_input_stream(blocks._opened(name)[1]) as part:
                            shutil.copyfileobj(part, out, 4 << 20)
            yield b

    if joined:
        for module in (blocks, sys.modules[__name__]):
            register_pickle_by_value(module)  # so that tasks need no installed package
        spark.range(0, len(joined), 1, len(joined)).mapInArrow(run, "id long").collect()


def is_folder(spark: SparkSession, name: str) -> bool:
    """Whether there is a folder of that name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return any(f.isDirectory() for f in found or ())


def stat_files(spark: SparkSession, folder: str, pattern: str = "*") -> list[tuple[str, str, int, int]]:
    """Name, path, size and time of the files that match a pattern below a folder, by path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(((f.getPath().getName(), f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found or []), key=lambda f: f[1])


def move_new(spark: SparkSession, old: str, new: str) -> bool:
    """Rename a file or folder in one step; false, with nothing done, where the new name is taken."""
    jvm = spark._jvm
    path, conf = jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    store = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(new).toUri(), conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        store.rename(path(old), path(new), none)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or store.util().exists(path(new)):
            path(old).getFileSystem(conf).delete(path(old), True)
            return False
        raise
    return True
