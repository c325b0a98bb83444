"""Hierarchical packing of documents into sequences of several context sizes."""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, slices
from auditlake.llm.encode import encoder

_ARROW = pa.schema([(n, pa.int32() if n in ("part", "chunk", "tier") else pa.int64()) for n in ("part", "chunk", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "seq", "offset", "tier", "step")] + [("ids", pa.list_(pa.int32()))])
_SCHEMA = "part int, chunk int, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, seq long, offset long, tier int, step long, ids array<int>"


def pack(lengths: list[int], tiers: tuple[int, ...] = (256, 512, 1024, 2048)) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of pieces (document, start, length) that cut ``lengths`` without a gap.

    Whole windows of the longest tier come off first. What remains of a document is routed to the
    smallest tier that holds it. Tiers are packed from long to short: the longest remainder opens
    a window of its tier, and the gap is filled with the longest remainder that fits, again and
    again; if none fits, the shortest one is cut. So every window is full but the last, which is
    cut into windows of powers of two. Ties go to the earlier document.
    """
    longest = tiers[-1]
    windows, rest = [], []
    for d, n in enumerate(lengths):
        windows += [[(d, s, longest)] for s in range(0, n - longest + 1, longest)]
        if n % longest:
            rest.append((n % longest, -d, n - n % longest))
    rest.sort()
    while rest:
        n, d, s = rest.pop()
        size = tiers[bisect_left(tiers, n)]
        window, gap = [(-d, s, n)], size - n
        while gap and rest:
            i = bisect_right(rest, (gap, 1, 0)) - 1
            if i >= 0:
                n, d, s = rest.pop(i)
            else:
                n, d, s = rest.pop(0)
                item = (n - gap, d, s + gap)
                rest.insert(bisect_left(rest, item), item)
                n = gap
            window.append((-d, s, n))
            gap -= n
        if not gap:
            windows.append(window)
            continue
        total = size - gap  # the last window of all
        for bit in range(total.bit_length() - 1, -1, -1):
            want, part = total & (1 << bit), []
            while want:
                d, s, n = window.pop(0)
                if n > want:
                    window.insert(0, (d, s + want, n - want))
                    n = want
                part.append((d, s, n))
                want -= n
            if part:
                windows.append(part)
    return windows


def step_groups(windows: list[list[tuple[int, int, int]]], size: int) -> list[int]:
    """A group for each window: windows of one length, about ``size`` to a group, dealt in a snake by attention cost."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(windows):
        by.setdefault(sum(p[2] for p in w), []).append(i)
    out, first = [0] * len(windows), 0
    for length in sorted(by):
        own = sorted(by[length], key=lambda i: (-sum(p[2] ** 2 for p in windows[i]), i))
        groups = -(-len(own) // size)
        for at, i in enumerate(own):
            row, col = divmod(at, groups)
            out[i] = first + (col if row % 2 == 0 else groups - 1 - col)
        first += groups
    return out


def _packer(tokenizer: str, end_id: int, tiers: tuple[int, ...], docs_at_once: int, tokens_at_once: int, step_size: int, with_ids: bool):
    def rows(part: int, chunk: int, names: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        windows = pack([len(x) for x in ids], tiers)
        steps, out = step_groups(windows, step_size), []
        for seq, w in enumerate(windows):
            offset, tier = 0, sum(p[2] for p in w)
            for d, s, n in w:
                piece = ids[d][s : s + n]
                out.append((part, chunk, names[d], s, n, zlib.crc32(piece.astype("<u4").tobytes()), len(ids[d]), seq, offset, tier, steps[seq], piece.astype(np.int32) if with_ids else None))
                offset += n
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, chunk = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype)
        names, ids, held = [], [], 0
        for b in slices(batches, 500):
            names += b["doc_id"].to_pylist()
            ids += [np.concatenate([x, end]) for x in enc.encode(b["text"].to_pylist())]
            held += sum(map(len, ids[-b.num_rows :]))
            if len(ids) >= docs_at_once or held >= tokens_at_once:
                yield rows(part, chunk, names, ids)
                names, ids, held, chunk = [], [], 0, chunk + 1
        if ids:
            yield rows(part, chunk, names, ids)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, tiers: tuple[int, ...] = (256, 512, 1024, 2048), id_col: str = "doc_id", text_col: str = "text", docs_at_once: int = 4096, tokens_at_once: int = 8_000_000, step_size: int = 64, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of the sizes in ``tiers`` with hardly any padding.

    Each task encodes the documents of its part of the input as they come and packs about
    ``docs_at_once`` of them at a time (or ``tokens_at_once`` tokens), so no text is shuffled and a
    task's memory is bounded; the numbering of sequences follows the parts of the input. Every
    sequence is exactly full, but the last ones of a chunk have lengths of smaller powers of two.

    Returns a row per piece: ``doc_id, start`` (ids of its document before it), ``length,
    ids_crc32, doc_tokens`` (with the end id), ``sequence_id, offset`` (in the sequence), ``tier``
    (length of the sequence), ``step_group`` (sequences of one length and about equal attention
    cost) and, if ``with_ids``, ``ids``. Null texts count as empty: a piece with the end id. Null
    ids stay null. Repeated rows are documents of their own. An empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = scratch.cut(rows.mapInArrow(_packer(tokenizer, end_id, tiers, docs_at_once, tokens_at_once, step_size, with_ids), _SCHEMA))
    sizes = pieces.groupBy("part", "chunk").agg((F.max("seq") + 1).alias("seqs"), (F.max("step") + 1).alias("steps"))
    before = Window.orderBy("part", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.cut(sizes.select("part", "chunk", F.coalesce(F.sum("seqs").over(before), F.lit(0)).alias("seq0"), F.coalesce(F.sum("steps").over(before), F.lit(0)).alias("step0")))
    out = pieces.join(base, ["part", "chunk"])
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("seq0") + F.col("seq")).alias("sequence_id"), "offset", "tier", (F.col("step0") + F.col("step")).alias("step_group"), *(["ids"] if with_ids else []))
