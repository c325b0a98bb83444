"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, components, mix, shingles, slices

_EMPTY = np.uint64(2**64 - 1)


def fast_sketch(items: np.ndarray, t: int = 128) -> np.ndarray:
    """The fast similarity sketch of a non-empty set of 64-bit hashes; ``t`` is a power of two.

    Round ``i`` throws every item into a random bin with the value ``i`` plus a random fraction,
    and a bin keeps its least value. The first ``t`` rounds choose the bin by hash, the next
    ``t`` rounds aim all items at bin ``i - t``, so every coordinate is filled after ``2 t``
    rounds at the latest, and after about ``t log t / n`` rounds as a rule. Later rounds only
    hold larger values, so rounds can be thrown in blocks and stop once no bin is empty. Equal
    coordinates of two sketches are an unbiased, concentrated estimate of the Jaccard index.
    """
    out = np.full(t, _EMPTY)
    shift = np.uint64(64 - (t.bit_length() - 1))
    fraction = np.uint64((1 << 48) - 1)
    block = max(1, int(np.ceil(t * np.log(t) / len(items))))
    i = 0
    while i < 2 * t:
        stop = min(i + block, t if i < t else 2 * t)
        rounds = np.arange(i, stop, dtype=np.uint64)[:, None]
        h = mix(items[None, :] ^ mix(rounds + np.uint64(0x51ED270B)))
        value = (rounds << np.uint64(48)) | (h & fraction)
        if i < t:
            np.minimum.at(out, (h >> shift).astype(np.int64).ravel(), value.ravel())
        else:
            out[i - t : stop - t] = np.minimum(out[i - t : stop - t], value.min(axis=1))
        if not (out == _EMPTY).any():
            break
        i = stop
    return out


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for every ``rows`` coordinates, different for different bands."""
    parts = sketch.reshape(-1, rows)
    key = np.arange(len(parts), dtype=np.uint64)
    for j in range(rows):
        key = mix(key ^ parts[:, j]) + np.uint64(0x632BE59BD9B4E019)
    return mix(key)


def _sketches(k: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            n, keys, band = [], [], []
            for text in b["text"].to_pylist():
                s = shingles(text, k)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b"")
                band.append(band_keys(fast_sketch(s, bands * rows), rows).view(np.int64) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_pydict({"id": b["id"], "n": n, "key": pa.array(keys, pa.binary()), "bands": pa.array(band, pa.list_(pa.int64())), "hash": b["hash"]})

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            yield pa.RecordBatch.from_pydict({"id": b["id"], "items": pa.array([shingles(t, k).tobytes() for t in b["text"].to_pylist()], pa.binary())})

    return run


def _items(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 200):
            sets = [shingles(t, k).view(np.int64) for t in b["text"].to_pylist()]
            sizes = [len(s) for s in sets]
            yield pa.RecordBatch.from_pydict({"id": np.repeat(b["id"].to_numpy(), sizes), "n": np.repeat(np.array(sizes, np.int64), sizes), "item": np.concatenate([np.empty(0, np.int64), *sets])})

    return run


def _verify(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = []
            for x, y in zip(b["x"], b["y"], strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                both = int((q[at] == p).sum())
                good.append(100 * both >= percent * (len(p) + len(q) - both))
            yield b.loc[good, ["a", "b"]]

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, star_rounds: int = 2, text_hash: str | None = None) -> DataFrame:
    """Group documents whose sets of ``k``-word shingles overlap by ``percent`` of their union or more.

    Documents with the same set are first taken as one. The others meet in the bands of their
    sketches: a pair at the threshold is missed by all bands with probability
    ``(1 - (percent/100) ** rows) ** bands`` (5e-6 by default). Candidates are confirmed on the
    full sets. To join the groups without emitting all pairs of a large bucket, every bucket
    first compares its members with one of them (``star_rounds`` times, with another one each
    time and only members not yet in the same component). Members of buckets that still hold
    several components afterwards are compared by prefix: sets that overlap enough share one of
    their ``n - ceil(n percent / 100) + 1`` rarest shingles, and the first one they share leaves
    enough behind it on either side, so pairs across components for which no shingle does are no
    links. Pairs within a component are never needed. So no link of a bucket
    is lost, and what a heavily edited copy has of its own keeps it from meeting its whole group.

    Returns a row per input row: ``doc_id, n_shingles, component_id, kept``. The component is the smallest id reachable over links. Texts that are null or
    hold no word have an empty set, link with nothing and are kept. Rows with a null id take no
    part: null component, kept. Rows that share an id count as one document that links through
    any of its texts; each is reported, and where two of its texts are in different groups, each with
    its own group. ``text_hash`` names a further column, the xxhash64 of the text, that tells them apart. Other columns are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = scratch.cut(base.withColumn("hash", F.xxhash64("text")).mapInArrow(_sketches(k, bands, rows), "id long, n long, key binary, bands array<long>, hash long"))
    real = sketched.filter("n > 0 AND id IS NOT NULL")
    classes = scratch.cut(real.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    spread = classes.select("id", "n", F.explode("bands").alias("band"))
    shared = scratch.cut(spread.groupBy("band").agg(F.count("*").alias("c")).filter("c > 1").select("band"))
    members = scratch.cut(spread.join(shared, "band").withColumn("comp", F.col("id")))
    links, tested, comps = None, None, None

    def close(x: str, y: str) -> Column:
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    def confirm(pairs: DataFrame) -> DataFrame:
        nodes = scratch.cut(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
        sets = scratch.cut(base.join(nodes, "id", "left_semi").mapInArrow(_sets(k), "id long, items binary").filter(F.length("items") > 0).distinct())
        left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
        right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
        out = scratch.cut(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInPandas(_verify(percent), "a long, b long").distinct())
        scratch.drop(nodes, sets)
        return out

    for r in range(star_rounds + 1):
        if r < star_rounds:  # one member of each bucket against the others
            order = F.struct((F.col("id") if r == 0 else F.xxhash64("id", F.lit(r))).alias("o"), "id", "n", "comp")
            hub = scratch.cut(members.groupBy("band").agg(F.min(order).alias("hub")))
            met = members.join(hub, "band").select("id", "n", "comp", F.col("hub.id").alias("id2"), F.col("hub.n").alias("n2"), F.col("hub.comp").alias("comp2"))
        else:  # what is left: pairs across components that share a rare shingle
            nodes = scratch.cut(members.select("id", "comp").distinct())
            items = scratch.cut(base.join(nodes.select("id"), "id", "left_semi").mapInArrow(_items(k), "id long, n long, item long").distinct())
            common = scratch.cut(items.groupBy("item").agg(F.count("*").alias("df")).filter("df > 1"))
            rank = F.row_number().over(Window.partitionBy("id", "n").orderBy("df", "item")) + F.col("n") - F.count("*").over(Window.partitionBy("id", "n"))
            # a shingle of one document is rarer than all others, so those only move the ranks up
            ranked = items.join(common, "item").withColumn("rank", rank)
            rare = scratch.cut(ranked.filter(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).join(nodes, "id").select("item", "id", "n", "comp", "rank"))
            other = rare.select("item", F.col("id").alias("id2"), F.col("n").alias("n2"), F.col("comp").alias("comp2"), F.col("rank").alias("rank2"))
            # if this is the first shingle that they share, so many can follow it
            most = 1 + F.least(F.col("n") - F.col("rank"), F.col("n2") - F.col("rank2"))
            met = rare.join(other, "item").filter((F.col("id") < F.col("id2")) & (most * (100 + percent) >= percent * (F.col("n") + F.col("n2"))))
        pairs = met.filter((F.col("comp") != F.col("comp2")) & close("n", "n2")).select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()
        pairs = scratch.cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        if not pairs.isEmpty():
            found = confirm(pairs)
            links = found if links is None else scratch.cut(links.unionByName(found))
            tested = pairs if tested is None else scratch.cut(tested.unionByName(pairs))
            comps = components(scratch, links)
        if comps is None or r == star_rounds:
            break
        named = members.drop("comp").join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        named = scratch.cut(named)
        still = scratch.cut(named.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band"))
        if still.isEmpty():
            break
        members = scratch.cut(named.join(still, "band", "left_semi"))
    # every class has its component; rows find theirs by the set they share
    part = classes.select("key", F.col("id").alias("rep"))
    if comps is not None:
        part = part.join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left")
    else:
        part = part.withColumn("component", F.lit(None).cast("long"))
    part = scratch.cut(part.select("key", F.coalesce("component", "rep").alias("component")))
    scratch.keep(sketched, part)
    out = sketched.select("id", "n", "key", "hash").join(part, "key", "left")
    empty = F.col("n") == 0
    comp = F.when(F.col("id").isNotNull(), F.when(empty, F.col("id")).otherwise(F.col("component")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"), *([F.col("hash").alias(text_hash)] if text_hash else []))
