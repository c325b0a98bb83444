"""Token files: flat unsigned integers and 64-bit document offsets, written and memory-mapped in parallel."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, local_path, slices
from auditlake.llm.encode import encoder

#: Stands for a null document id in the files.
NO_ID = -(2**63)


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name, mine = f"{folder}/part-{task.partitionId():06d}", f".{task.taskAttemptId()}"
        enc = encoder(tokenizer)
        files = {x: open(f"{name}.{x}{mine}", "wb") for x in ("tok", "off", "doc")}  # noqa: SIM115
        np.zeros(1, "<u8").tofile(files["off"])
        total = docs = 0
        for b in slices(batches, 500):
            ids = b["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
            sizes = []
            for x in enc.encode(b["text"].to_pylist()):
                files["tok"].write(x.tobytes() + np.array([end_id], enc.dtype).tobytes())
                sizes.append(len(x) + 1)
            (total + np.cumsum(sizes)).astype("<u8").tofile(files["off"])
            ids.astype("<i8").tofile(files["doc"])
            total, docs = total + sum(sizes), docs + b.num_rows
        for x, f in files.items():
            f.close()
            if docs:
                os.replace(f"{name}.{x}{mine}", f"{name}.{x}")  # a repeated task puts the same bytes there
            else:
                os.unlink(f"{name}.{x}{mine}")
        if docs:
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int32()), "file": [name], "docs": [docs], "tokens": [int(total)], "width": pa.array([enc.dtype.itemsize], pa.int32())})

    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Encode whole texts and write them in ascending document id order; returns the manifest.

    Rows are dealt by ranges of (id, hash of the text), so that the files, taken by number, hold
    the documents in order; null ids come first, and rows that share an id follow the hash of
    their text. Each task writes three files: ``.tok`` (ids as little-endian unsigned 16-bit
    integers where all ids of the vocabulary fit, else 32-bit), ``.off`` (64-bit offsets, one more
    than documents) and ``.doc`` (64-bit document ids, the least value for null). A task first
    writes under a name of its own and renames at its end, so a repeated task does no harm.
    ``folder`` must be mounted on driver and executors. The manifest has one row per file: ``part,
    file, docs, tokens, width, first_doc, first_token``; the last two are prefix sums over the
    files before it. A null text counts as empty: it holds the end id alone. An empty table gives
    an empty manifest.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    path = local_path(folder)
    os.makedirs(path, exist_ok=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("_h", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    done = scratch.cut(ordered.mapInArrow(_writer(path, tokenizer, end_id), "part int, file string, docs long, tokens long, width int"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return done.select("*", F.coalesce(F.sum("docs").over(before), F.lit(0)).alias("first_doc"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first_token"))


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for r in b.itertuples():
            offsets, ids = np.memmap(f"{r.file}.off", "<u8", "r"), np.memmap(f"{r.file}.doc", "<i8", "r")
            tokens = np.memmap(f"{r.file}.tok", f"<u{r.width}", "r")
            for i in range(0, len(ids), 5000):
                at = offsets[i : i + 5001].astype(np.int64)
                own = pd.Series(np.array(ids[i : i + 5000]), dtype="Int64")
                crc = [zlib.crc32(tokens[x:y].astype("<u4").tobytes()) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": own.mask(own == NO_ID), "start": r.first_token + at[:-1], "n_tokens": np.diff(at), "ids_crc32": crc})


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document, read from the memory-mapped files: ``doc_id, start, n_tokens, ids_crc32``."""
    spread = manifest.select("file", "width", "first_token").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "file")
    return spread.mapInPandas(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    scratch = Scratch(spark)
    manifest = scratch.cut(write_token_files(docs, f"{scratch.root}/tokens", tokenizer, end_id, scratch=scratch))
    return read_token_files(manifest)
