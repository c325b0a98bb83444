"""Log files that grow: a streaming source that reads on where it stopped in each file."""

from __future__ import annotations

import json
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from auditlake.sources import blocks

#: Bytes at the start of a file by which it is known again, and bytes read at once in search of a line end.
HEAD, _READ = 1024, 1 << 20
_BATCH = 4 << 20


class _Range(InputPartition):
    """Lines of a file that begin in ``[start, end)``; ``whole`` if a line begins at ``start`` for certain."""

    def __init__(self, path: str, start: int, end: int, whole: bool):
        self.path, self.start, self.end, self.whole = path, start, end, whole


def _last_line_end(stream, high: int) -> int:
    """The place behind the last line end before ``high``, or 0; read from the back."""
    while high > 0:
        start = max(0, high - _READ)
        stream.seek(start)
        at = stream.read(high - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        high = start
    return 0


def _head(stream, size: int) -> int:
    stream.seek(0)
    return zlib.crc32(stream.read(size))


def lines_of(stream, start: int, end: int, whole: bool) -> Iterator[tuple[int, bytes]]:
    """``(place, bytes)`` of the lines that begin in ``[start, end)``, each to its end."""
    base = start if whole else start - 1
    stream.seek(base)
    buf, skipping = b"", not whole
    while base < end:
        more = stream.read(_READ)
        buf += more
        at = 0
        while base + at < end and (stop := buf.find(b"\n", at)) >= 0:
            if not skipping:
                yield base + at, buf[at:stop]
            skipping, at = False, stop + 1
        buf, base = buf[at:], base + at
        if not more:
            return


class TailReader(DataSourceStreamReader):
    """Offsets are, for each file: bytes done, size and time when last seen, and length and checksum of its head.

    A file that is shorter than what was done, or whose head differs, has begun anew. That is told
    from the offsets alone, so a restarted query goes on as one that never stopped.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.block, self.encoding = options["path"], int(options.get("blockbytes", 1 << 27)), options.get("encoding", "utf-8")
        self.seen: dict[str, dict] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        store, path = blocks._opened(self.path)
        found = {}
        for f in store.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if f.is_file and f.base_name.endswith(".log"):
                before = self.seen.get(f.path)
                found[f.path] = before if before and (before["size"], before["mtime"]) == (f.size, f.mtime_ns) else self._looked(store, f)
        self.seen = found
        return {"files": found}

    def _looked(self, store: pafs.FileSystem, f: pafs.FileInfo) -> dict:
        with store.open_input_file(f.path) as stream:
            done = _last_line_end(stream, f.size)
            head = min(HEAD, done)
            return {"done": done, "size": f.size, "mtime": f.mtime_ns, "head": head, "crc": _head(stream, head)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        store, _ = blocks._opened(self.path)
        news = []
        for path, now in sorted(end["files"].items()):
            before, at = start["files"].get(path), 0
            if before == now:
                continue
            if before and now["done"] >= before["done"]:
                with store.open_input_file(path) as stream:
                    at = before["done"] if _head(stream, before["head"]) == before["crc"] else 0
            news.append((path, at, now["done"]))
        step = blocks.width(self.block, sum(done - at for _, at, done in news))
        return [_Range(path, i, min(i + step, done), i == at) for path, at, done in news for i in range(at, done, step)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        store, _ = blocks._opened(self.path)
        name = partition.path.rpartition("/")[2]
        places, texts, size = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(texts)), pa.array([partition.path] * len(texts)), pa.array(places, pa.int64()), pa.array(texts, pa.string())], schema=blocks._SCHEMA)

        with store.open_input_file(partition.path) as stream:
            for at, raw in lines_of(stream, partition.start, partition.end, partition.whole):
                texts.append(raw.removesuffix(b"\r").decode(self.encoding, "replace"))
                places.append(at)
                size += len(raw)
                if size >= _BATCH:
                    yield batch()
                    places, texts, size = [], [], 0
        if texts:
            yield batch()

    def commit(self, end: dict) -> None:
        """Nothing is kept but the offset, which Spark has in its log."""


class LogTail(DataSource):
    """Options ``path``, ``blockBytes`` and ``encoding``; see :func:`tail_lines`."""

    @classmethod
    def name(cls) -> str:
        return "logtail"

    def schema(self) -> str:
        return "file string, path string, pos long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})


def tail_lines(spark: SparkSession, folder: str, block_bytes: int = 1 << 27, encoding: str = "utf-8") -> DataFrame:
    """Lines of the ``*.log`` files of a folder as they are written: a stream of ``file, path, pos, value``.

    A file that grows is read on from where it stopped; what stands behind its last line end waits
    until the line is complete. A file that is shorter than before, or begins otherwise, is read from
    its start again; one that goes is forgotten. New text is cut into blocks of ``block_bytes``, a
    task each, longer ones where there would be too many. The offset has an entry for each file there is, so files that are done should be moved
    away. Files whose size and time are as before are not opened.
    """
    for module in (blocks, sys.modules[__name__]):
        register_pickle_by_value(module)  # so that tasks need no installed package
    spark.dataSource.register(LogTail)
    return spark.readStream.format("logtail").option("blockBytes", block_bytes).option("encoding", encoding).load(folder)
