"""Records of several lines, read block by block: a data source whose tasks finish the record they began."""

from __future__ import annotations

import fnmatch
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Stores that tasks can open by themselves; for others there is :func:`auditlake.sources.logs.assemble`.
STORES = ("", "file", "s3", "gs")
#: What the first line of a record looks like, behind a line end.
_HEADER = re.compile(rb"(?<=\n)\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d+ \(EP\[")
_SCHEMA = pa.schema([("file", pa.string()), ("path", pa.string()), ("pos", pa.int64()), ("value", pa.string())])
_READ = 1 << 20
_BATCH = 4 << 20
#: Tasks beyond which blocks grow, and their size where they stop growing: each task is sent the list of all.
TASKS, MOST = 500, 1 << 27


def scheme(path: str) -> str:
    return path.split(":", 1)[0] if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path) else ""


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if scheme(path) in ("", "file"):
        plain = re.sub(r"^file:/*", "/", path)
        return pafs.LocalFileSystem(), plain
    return pafs.FileSystem.from_uri(path)


def width(block: int, total: int) -> int:
    """The length of the blocks of ``total`` bytes: ``block``, or more where that would make too many tasks."""
    return max(block, min(MOST, -(-total // TASKS)))


class _Block(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def records_of(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """``(place, bytes)`` of the records that begin in ``[start, end)``, each to its end, wherever that is.

    Lines before the first record of a block belong to a block before, which reads on for them.
    Lines before the first record of the file are single rows of the first block.
    """
    stream.seek(max(start - 1, 0))
    base, buf = max(start - 1, 0), b""
    if start == 0:
        base, buf = -1, b"\n"  # as if a line end stood before the file
    opened, searched, leading = None, 0, start == 0
    while True:
        more = stream.read(_READ)
        buf += more
        for m in _HEADER.finditer(buf, searched):
            at = m.start()
            if opened is not None:
                yield base + opened, buf[opened:at]
            elif leading:
                yield from _lines(base, buf, 1, at)
            opened, leading = at, False
            if base + at >= end:
                return
        if not more:
            if opened is not None:
                yield base + opened, buf[opened:]
            elif leading:
                yield from _lines(base, buf, 1, len(buf))
            return
        last = max(buf.rfind(b"\n"), 0)
        if opened is None and not leading and base + last + 1 >= end:
            return
        # the next header begins behind the last line end, which is kept for it
        keep = 0 if leading else min(last, last if opened is None else opened - 1)
        buf, base, searched = buf[keep:], base + keep, last - keep
        if opened is not None:
            opened -= keep
            searched = max(searched, opened + 1)


def _lines(base: int, buf: bytes, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    while start < end:
        stop = buf.find(b"\n", start, end)
        stop = end if stop < 0 else stop + 1
        yield base + start, buf[start:stop]
        start = stop


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.block, self.encoding = options["path"], int(options.get("blockbytes", 1 << 27)), options.get("encoding", "utf-8")

    def partitions(self) -> list[InputPartition]:
        store, path = _opened(self.path)
        info = store.get_file_info(path)
        if info.type == pafs.FileType.File:
            files = [info]
        elif info.type == pafs.FileType.Directory:
            files = [f for f in store.get_file_info(pafs.FileSelector(path)) if f.base_name.endswith(".log")]
        else:
            folder, _, pattern = path.rpartition("/")
            files = [f for f in store.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if fnmatch.fnmatchcase(f.base_name, pattern)]
            if not files:
                raise FileNotFoundError(f"PATH_NOT_FOUND: {self.path}")
        files = sorted((f for f in files if f.is_file), key=lambda f: f.path)
        step = width(self.block, sum(f.size for f in files))
        return [_Block(f.path, i, min(i + step, f.size)) for f in files for i in range(0, f.size, step)]

    def read(self, partition: _Block) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        name = partition.path.rpartition("/")[2]
        places, texts, size = [], [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(texts)), pa.array([partition.path] * len(texts)), pa.array(places, pa.int64()), pa.array(texts, pa.string())], schema=_SCHEMA)

        with store.open_input_file(partition.path) as stream:
            for at, raw in records_of(stream, partition.start, partition.end):
                raw = raw[:-1] if raw.endswith(b"\n") else raw
                text = raw.decode(self.encoding, "replace")
                texts.append(text.replace("\r\n", "\n").removesuffix("\r") if "\r" in text else text)
                places.append(at)
                size += len(raw)
                if size >= _BATCH:
                    yield batch()
                    places, texts, size = [], [], 0
        if texts:
            yield batch()


class LogBlocks(DataSource):
    """Options ``path``, ``blockBytes`` and ``encoding``; see :func:`read_records`."""

    @classmethod
    def name(cls) -> str:
        return "logblocks"

    def schema(self) -> str:
        return "file string, path string, pos long, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


def read_records(spark: SparkSession, path: str, block_bytes: int = 1 << 27, encoding: str = "utf-8") -> DataFrame:
    """Whole records, of one line or more, of a log file, of the ``*.log`` files of a folder, or of those a pattern names.

    Files are cut into blocks of ``block_bytes``, a task each; where that would be more than some
    hundreds of tasks, blocks are longer, up to 128 MB. A task skips what stands before the
    first record of its block and reads beyond its end until the next record begins, however many
    blocks that takes. So every file is read once (but for those ends), nothing is sorted or
    shuffled, and a large file is read by many tasks. ``pos`` is the place in bytes. Lines before
    the first record of a file stay single and will not parse. ``encoding`` may be ``gb18030``.
    """
    register_pickle_by_value(sys.modules[__name__])  # so that tasks need no installed package
    spark.dataSource.register(LogBlocks)
    return spark.read.format("logblocks").option("blockBytes", block_bytes).option("encoding", encoding).load(path)
