"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import WORD, Scratch
from auditlake.operators.shaping import with_rank

#: Documents of a source that the landing decides together.
LANDING = 12
_TINY = 1e-9
#: Equal rows that are told apart at a time.
_MANY = 4096
_COLUMNS = ("doc_id", "h", "sid", "size", "base", "pi", "block")


def ladder(sizes: list[int], pi: list[float], rungs: int) -> list[int]:
    """Undecided units for the landing, about each half the size of the one before, the largest one first.

    Their sums come near to any number of tokens, whatever units the flight leaves undecided.
    """
    left = [i for i, p in enumerate(pi) if _TINY < p < 1 - _TINY]
    out: list[int] = []
    rung = float(max((sizes[i] for i in left), default=0))
    while left and len(out) < rungs:
        near = min(left, key=lambda i: (abs(math.log2(max(sizes[i], 0.5)) - math.log2(max(rung, 0.5))), i))
        out.append(near)
        left.remove(near)
        rung = min(rung, sizes[near]) / 2
    return out


def flight(sizes: list[int], pi: list[float], rng: random.Random, spare: int = 0) -> list[float]:
    """Move inclusion probabilities to 0 or 1 until at most two are left in between, and ``spare`` more for the landing (see :func:`ladder`).

    With three undecided units there is a direction that changes neither the expected number of
    documents nor the expected number of tokens: the cross product of (1, 1, 1) and the sizes.
    The walk goes along it, forwards or backwards with the chances that keep every expectation,
    until a unit reaches 0 or 1 and the next one takes its place.
    """
    out, live = list(pi), []
    kept = set(ladder(sizes, pi, spare)) if spare else set()
    for i in (i for i, p in enumerate(pi) if _TINY < p < 1 - _TINY and i not in kept):
        live.append(i)
        while len(live) == 3:
            a, b, c = (sizes[j] for j in live)
            u = (c - b, a - c, b - a)
            if not any(u):
                u = (1, -1, 0)
            ahead = min(((1 - out[j]) / x if x > 0 else -out[j] / x) for j, x in zip(live, u, strict=True) if x)
            back = min((out[j] / x if x > 0 else (out[j] - 1) / x) for j, x in zip(live, u, strict=True) if x)
            move = ahead if rng.random() * (ahead + back) < back else -back
            for j, x in zip(live, u, strict=True):
                out[j] += move * x
                if not _TINY < out[j] < 1 - _TINY:
                    out[j] = float(round(out[j]))
            live = [j for j in live if 0 < out[j] < 1]
    return [float(round(p)) if not _TINY < p < 1 - _TINY else p for p in out]


def settle(sizes: list[int], pi: list[float], rng: random.Random, large: float = 0.05) -> list[float]:
    """Decide units of more than the share ``large`` of all expected tokens first, the largest ones before the others.

    Each is taken with its probability; what it has more or less than expected is made up for by
    the probabilities of the smaller units, in proportion to their variance. As that is linear,
    every expectation stays, and so does the total of tokens. Where the smaller ones can't make up
    for it, a unit stays undecided.
    """
    p, z = np.array(pi), np.array(sizes, float)
    free = (p > _TINY) & (p < 1 - _TINY)
    total = float((p * z).sum())
    for i in sorted(np.flatnonzero(free).tolist(), key=lambda i: -sizes[i]):
        if sizes[i] <= large * total:
            break
        took = 1.0 if rng.random() < p[i] else 0.0
        rest = free & (z < z[i])
        w = np.where(rest, p * (1 - p), 0.0)
        if not (w * z).sum():
            continue
        new = p - (took - p[i]) * z[i] * w / (w * z).sum()
        if new[rest].min() >= 0 and new[rest].max() <= 1:
            new[i], free[i], p = took, False, new
    return p.tolist()


def land(sizes: list[int], pi: list[float]) -> list[float]:
    """Decide the last few units: the choice whose tokens, then documents, come nearest to what was expected."""
    live = [i for i, p in enumerate(pi) if 0 < p < 1]
    z, p = np.array([sizes[i] for i in live], float), np.array([pi[i] for i in live])
    picks = (np.arange(1 << len(live))[:, None] >> np.arange(len(live))) & 1
    best = np.lexsort((np.abs(picks.sum(1) - p.sum()).round(6), np.abs(picks @ z - z @ p).round(6)))[0]
    out = list(pi)
    for x, i in zip(picks[best].tolist(), live, strict=True):
        out[i] = float(x)
    return out


def _flown(level: int, last: bool):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("h", "ascending"), ("doc_id", "ascending")])
        sizes, pi = t["size"].to_pylist(), t["pi"].to_pylist()
        rng = random.Random(f"{level}:{key[0].as_py()}:{key[1].as_py()}")
        pi = settle(sizes, pi, rng)
        pi = flight(sizes, pi, rng, LANDING - 2 if last else 0)
        return t.set_column(t.schema.get_field_index("pi"), "pi", pa.array(land(sizes, pi) if last else pi, pa.float64()))

    return run


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """``source, sid, source_size, docs, target`` from ``source, size`` rows.

    Shares of the total follow the weights, capped at ``most`` times a source's size, what is cut
    being shared again by weight: the level of a unit of weight is raised, by sums over all sources, until it
    takes no further source above its cap. Sources are ranked range by range, so neither needs
    one task for all of them.
    """
    scratch = Scratch(sizes.sparkSession)
    per = scratch.cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    per = with_rank(per, F.col("source").asc_nulls_last()).withColumnRenamed("rank", "sid")
    per = scratch.cut(per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))))
    cap = F.lit(most).cast("long") * F.col("source_size")
    total, level, full = per.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        over = cap <= F.col("w") * level
        n, caps, weight = per.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("w")))).first()
        if n == full or not weight:
            break
        level, full = (total - (caps or 0)) / weight, n
    return per.select("source", "sid", "source_size", "docs", F.least(cap.cast("double"), F.col("w") * level).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, block: int = 1000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Choose how often each document is taken so that sources meet their target sizes.

    Sources in code point order, null last, get ``weights`` in turn; see :func:`source_targets`. A
    source with target/size ``r`` takes every document ``floor(r)`` times, and once more with
    probability ``r - floor(r)``, decided by the cube method balanced on tokens and documents. The
    flight runs in blocks of about ``block`` documents, formed by the hash of id and text, equal rows being
    numbered first, and texts that
    make up much of a block being decided first; at most two
    undecided documents of each block meet in the blocks of the next level, until one block per
    source is left, whose last dozen, on a ladder of sizes, land nearest to the target. So no task ever sees a whole source,
    and as blocks, their order and their random numbers follow from the ids, reruns agree.

    Returns a row per input row: ``doc_id, source, size`` (words of the text; null: 0),
    ``source_size, target`` (of its source), ``taken`` (size times copies) and ``copies`` (0 to
    ``most``), then the columns named in ``carry``. Repeated rows are documents of their own, and so are rows with a null id. A source
    without words has target 0 and is not taken. An empty table gives no row.
    """
    scratch = Scratch(docs.sparkSession)
    size = F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(F.col(text_col), F.lit(WORD))).cast("long")
    rows = scratch.cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("words_hash"), *[F.col(c).alias(f"carry_{c}") for c in carry]))
    per = scratch.cut(source_targets(rows, weights, most))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(rate + _TINY)
    # equal rows are numbered, so that many of them are in many blocks
    number = lambda frm, to: F.explode(F.sequence(frm, to))
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("equal")).withColumn("many", number(F.lit(0).cast("long"), F.floor((F.col("equal") - 1) / _MANY)))
    rows = counted.withColumn("number", number(F.col("many") * _MANY, F.least("equal", (F.col("many") + 1) * _MANY) - 1))
    h = F.xxhash64("doc_id", "size", "words_hash", *[f"carry_{c}" for c in carry], "number")
    state = rows.join(per.withColumnRenamed("source", "own"), F.col("source").eqNullSafe(F.col("own"))).select(
        "doc_id", h.alias("h"), "sid", "size", whole.cast("int").alias("base"),
        F.greatest(F.lit(0.0), rate - whole).alias("pi"), F.pmod(h, F.ceil(F.col("docs") / block)).cast("int").alias("block"),
        *[f"carry_{c}" for c in carry],
    )
    blocks, done, level = -(-(per.agg(F.max("docs")).first()[0] or 1) // block), None, 0
    schema = state.select(*_COLUMNS, *[f"carry_{c}" for c in carry]).schema
    while True:
        last = blocks == 1
        flown = scratch.cut(state.groupBy("sid", "block").applyInArrow(_flown(level, last), schema))
        settled = flown.filter("pi = 0 OR pi = 1")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        # every block leaves two documents at most, so half a block of blocks fills one of the next level
        state = flown.filter("pi > 0 AND pi < 1").withColumn("block", F.floor(F.col("block") / (block // 2)).cast("int"))
        blocks, level = -(-blocks // (block // 2)), level + 1
    copies = F.col("base") + F.col("pi").cast("int")
    named = per.select("sid", "source", "source_size", "target")
    out = done.join(named, "sid")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"), *[F.col(f"carry_{c}").alias(c) for c in carry if c not in ("doc_id", "source")])
