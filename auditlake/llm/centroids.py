"""Centroid clustering over zone maps: blocks of Hilbert-ordered vectors, bounded by boxes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch

#: Components beyond this, as integers, would let a squared distance pass 64 bits.
LARGEST = 2**27
#: Up to this size, products summed over a vector are exact in double precision.
EXACT = 2**22
_ROWS = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("start", pa.string())])
_BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("m", pa.binary()), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64())), ("total", pa.list_(pa.int64()))])
_SUMS = "cluster int, dim int, s long, n long, compared long"
_OUT = "vec_id long, cluster int, distance long, candidates int"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _quantised(dims: int, scale: int, prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.floor(scale * _matrix(b["x"], dims).astype(np.float64))
            if np.abs(x).max() > LARGEST:
                raise ArithmeticError(f"a component is beyond {LARGEST} after scaling: distances would pass 64 bits")
            ids = b["vec_id"].to_pylist()
            start = [None if i is None else hashlib.sha256(f"{prefix}{i}".encode()).hexdigest() for i in ids]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dims, dtype=np.int32)), pa.array(x.astype(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b["vec_id"], flat, pa.array(start, pa.string())], schema=_ROWS)

    return run


def hilbert_keys(x: np.ndarray, bits: int) -> list[bytes]:
    """Places of integer points with ``bits`` bits a component on the Hilbert curve, as byte strings in curve order.

    The points go through the curve's reflections and exchanges bit plane by bit plane, all at
    once, and the planes are then written one after the other, the highest first.
    """
    x = x.T.astype(np.uint32).copy()
    n = len(x)
    for plane in range(bits - 1, 0, -1):
        q, low = np.uint32(1 << plane), np.uint32((1 << plane) - 1)
        for i in range(n):
            hit = (x[i] & q) != 0
            swap = np.where(hit, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(hit, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint32)
    for plane in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] >> np.uint32(plane)) & 1, np.uint32((1 << plane) - 1), np.uint32(0))
    x ^= turn
    planes = [(x >> np.uint32(p)) & 1 for p in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).astype(np.uint8).T, axis=1)
    return [row.tobytes() for row in packed]


def _keyed(dims: int, low: np.ndarray, high: np.ndarray, bits: int):
    width = np.maximum(high - low + 1, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = ((_matrix(b["v"], dims) - low) << bits) // width
                yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], b["row"], pa.array(hilbert_keys(cells, bits), pa.binary())], ["vec_id", "v", "row", "key"])

    return run


def _blocked(dims: int, size: int):
    def block(ids: list, m: np.ndarray) -> tuple:
        return ids, np.ascontiguousarray(m).tobytes(), m.min(0).tolist(), m.max(0).tolist(), m.sum(0).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        m = np.empty((0, dims), np.int64)
        for b in batches:
            ids += b["vec_id"].to_pylist()
            m = np.concatenate([m, _matrix(b["v"], dims)])
            cuts = range(0, len(ids) - size + 1, size)
            if cuts:
                made = [block(ids[i : i + size], m[i : i + size]) for i in cuts]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)
                ids, m = ids[len(made) * size :], m[len(made) * size :]
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(block(ids, m), _BLOCKS, strict=True)], schema=_BLOCKS)

    return run


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of a box; ties stay in.

    A centroid goes if its least distance to the box is beyond the largest one of another, or if
    that other one, the nearest to the middle of the box, is nearer in every corner: the difference
    of two squared distances is linear in each component, so its largest value over the box is the
    sum of the larger values at the ends.
    """
    a, b = centroids - low, centroids - high
    least = (np.maximum(-a, 0) ** 2 + np.maximum(b, 0) ** 2).sum(1)
    most = np.maximum(a**2, b**2).sum(1)
    found = np.flatnonzero(least <= most.min())
    lead = found[np.argmin(((2 * centroids[found] - low - high).astype(np.float64) ** 2).sum(1))]
    # over the box, the largest of: squared distance to the lead less that to the other
    behind = np.maximum(a[lead] ** 2 - a[found] ** 2, b[lead] ** 2 - b[found] ** 2).sum(1)
    return found[behind >= 0]


def nearest_of(m: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row the nearest of the numbered centroids (ties: the first) and its squared distance, exactly."""
    c = centroids[numbers]
    kind = np.float64 if max(np.abs(m).max(initial=0), np.abs(c).max(initial=0)) <= EXACT else np.int64
    part = (c.astype(kind) ** 2).sum(1) - 2 * (m.astype(kind) @ c.T.astype(kind))
    at = part.argmin(1)
    own = numbers[at]
    return own, ((m - centroids[own]) ** 2).sum(1)


def _summed(centroids: np.ndarray):
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, compared = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), 0
        for b in batches:
            low, high, total = (_matrix(b[x], dims) for x in ("low", "high", "total"))
            for i in range(b.num_rows):
                near = candidates(low[i], high[i], centroids)
                m = b["m"][i].as_buffer()
                n = m.size // (8 * dims)
                if len(near) == 1:  # the whole block, without a look at its vectors
                    sums[near[0]] += total[i]
                    counts[near[0]] += n
                    continue
                m = np.frombuffer(m, np.int64).reshape(n, dims)
                own, _ = nearest_of(m, centroids, near)
                compared += n * len(near)
                for c in np.unique(own):
                    sums[c] += m[own == c].sum(0)
                    counts[c] += (own == c).sum()
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, dims).astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(used))), pa.array(sums[used].ravel()), pa.array(np.repeat(counts[used], dims)), pa.array(np.full(len(used) * dims, compared))],
            ["cluster", "dim", "s", "n", "compared"],
        )

    return run


def _assigned(centroids: np.ndarray):
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low, high = _matrix(b["low"], dims), _matrix(b["high"], dims)
            for i in range(b.num_rows):
                near = candidates(low[i], high[i], centroids)
                m = np.frombuffer(b["m"][i].as_buffer(), np.int64).reshape(-1, dims)
                own, distance = nearest_of(m, centroids, near)
                yield pa.RecordBatch.from_arrays([b["ids"][i].values, pa.array(own.astype(np.int32)), pa.array(distance), pa.array(np.full(len(m), len(near), np.int32))], ["vec_id", "cluster", "distance", "candidates"])

    return run


def zone_maps(vectors: DataFrame, scratch: Scratch, dims: int, bits: int, size: int) -> DataFrame:
    """Blocks of ``size`` vectors that follow one another on the Hilbert curve, each with its box and sum.

    ``vectors(vec_id, v)`` is a written table. Ranges are cut by place on the curve and then by row,
    so that equal vectors, however many, spread over tasks.
    """
    ends = vectors.select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("dim").collect()  # a row per component
    low, high = (np.array([r[x] for r in ends] or [0] * dims, np.int64) for x in ("low", "high"))
    # the table is read in the same parts however often, so numbers of rows stay the same
    rows = vectors.select("vec_id", "v", F.monotonically_increasing_id().alias("row"))
    keyed = rows.mapInArrow(_keyed(dims, low, high, bits), "vec_id long, v array<long>, row long, key binary")
    ordered = keyed.repartitionByRange("key", "row").sortWithinPartitions("key", "row")
    return scratch.cut(ordered.select("vec_id", "v").mapInArrow(_blocked(dims, size), "ids array<long>, m binary, low array<long>, high array<long>, total array<long>"))


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, prefix: str = "2:", bits: int = 4, size: int = 64, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """k-means with integer components and exact sums, the same whatever the order of the rows.

    Vectors with exactly ``dims`` components, none null or not finite, take part; each component
    becomes ``floor(scale * x)``. Centroids start as the ``k`` vectors whose ids have the smallest
    SHA-256 of ``prefix`` and id (repeated ids: the smaller vector first; vectors without an id
    never start one but belong to one; fewer rows than ``k`` start fewer). In each round every
    vector goes to its nearest centroid (ties: the smaller number), and a centroid that has vectors
    becomes the floor of their mean. After the last round vectors are assigned once more.

    Vectors are laid once along a Hilbert curve and cut into blocks of ``size`` with boxes. In each
    round a block compares its vectors with only those centroids that its box leaves possible; a
    block with a single one is added up without a look at its vectors. What goes to the driver and
    to tasks is ``k`` centroids of ``dims`` numbers, whatever the number of vectors.

    Returns a row per vector: ``vec_id, cluster, distance`` (squared), ``cluster_inertia, inertia``
    (distances added up), ``centroid_sha256`` and ``candidates`` (centroids compared in the last
    assignment). Repeated rows count each. An empty table gives no row. A component beyond 2**27
    after scaling raises ``ArithmeticError``, as distances would not fit 64 bits.
    """
    scratch = Scratch(vectors.sparkSession)
    x = F.col(vector_col)
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    whole = vectors.filter(F.coalesce((F.size(x) == dims) & finite, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), x.cast("array<double>").alias("x"))
    kept = scratch.cut(whole.mapInArrow(_quantised(dims, scale, prefix), "vec_id long, v array<long>, start string"))
    first = kept.filter("start IS NOT NULL").orderBy("start", "v").limit(k).collect()  # k rows
    if not first:
        rest = kept.select("vec_id", F.lit(0).alias("cluster")).limit(0)
        return rest.selectExpr("vec_id", "cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256", "0 AS candidates")
    centroids = np.array([r["v"] for r in first], np.int64)
    blocks = zone_maps(kept.select("vec_id", "v"), scratch, dims, bits, size)
    scratch.drop(kept)
    for _ in range(rounds):
        parts = blocks.mapInArrow(_summed(centroids), _SUMS)
        sums = parts.groupBy("cluster", "dim").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()  # k * dims rows
        moved = centroids.copy()
        for r in sums:
            moved[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
        centroids = moved
    found = scratch.cut(blocks.mapInArrow(_assigned(centroids), _OUT))
    scratch.drop(blocks)
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = found.sparkSession.createDataFrame([(i, inertia.get(i, 0), sum(inertia.values()), names[i]) for i in range(len(centroids))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "candidates")
