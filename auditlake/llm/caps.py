"""Near-duplicate vectors by spherical-cap filters from random product codes."""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, components, slices

#: Independent sets of codes, and filters of a set that two vectors at the threshold share on average.
SETS, COMMON = 4, 7
#: Filters of a set that every vector gets at least, its best ones if too few are exceeded.
FEWEST = 5
#: Vectors of a bucket that meet in one piece of work at most, on either side.
BLOCK = 1024


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Filters:
    """Sets of filter directions made of two blocks of random codes: ``size`` squared of them cost ``2 size`` products.

    The threshold is chosen so that a random vector of ``n`` others meets few of them by chance,
    and the number of codes so that a pair at cosine ``least`` has ``COMMON`` filters in common.
    """

    def __init__(self, dim: int, n: int, least: float, seed: int = 7):
        p = min(0.05, 8 / max(n, 1))
        t = NormalDist().inv_cdf(1 - p)
        # chance that the second vector passes a filter that the first one passes
        z = np.linspace(t, t + 6, 2000)
        w = np.exp(-z * z / 2)
        pass_ = np.array([NormalDist().cdf((least * x - t) / np.sqrt(1 - least * least)) for x in z])
        q = float((w * pass_).sum() / w.sum())
        self.size = max(4, int(np.ceil(np.sqrt(COMMON / (q * p)))))
        self.half, self.cut = max(1, dim // 2), t / np.sqrt(dim)
        rng = np.random.default_rng(seed)
        self.codes, self.turns = [], []
        for _ in range(SETS):
            # a random rotation, so that no vector has most of its length in one block
            q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
            self.turns.append((q * np.where(np.diag(r) < 0, -1.0, 1.0)).astype(np.float32))
            for d in (self.half, dim - self.half):
                c = rng.standard_normal((self.size, d))
                self.codes.append((c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12) * np.sqrt(d / dim)).astype(np.float32))

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each row of unit vectors the numbers of all filters that it exceeds, and its best few of a set at least."""
        sets = [self._decode(x, k) for k in range(SETS)]
        return [np.sort(np.concatenate(found)) for found in zip(*sets, strict=True)]

    def _decode(self, x: np.ndarray, k: int) -> list[np.ndarray]:
        x = x @ self.turns[k]
        first, second = x[:, : self.half] @ self.codes[2 * k].T, x[:, self.half :] @ self.codes[2 * k + 1].T
        order1, order2 = np.argsort(-first, axis=1), np.argsort(-second, axis=1)
        few = int(np.ceil(FEWEST**0.5)) * 4
        out = []
        for s1, s2, o1, o2 in zip(first, second, order1, order2, strict=True):
            a, b = s1[o1], s2[o2]
            # both lists descend: for each first code a prefix of the second ones exceeds the cut
            upto = np.searchsorted(-b, a - self.cut, side="right")
            upto = upto[: int((upto > 0).sum())]
            n = int(upto.sum())
            if n >= FEWEST:
                rows = np.repeat(np.arange(len(upto)), upto)
                cols = np.arange(n) - np.repeat(np.cumsum(upto) - upto, upto)
            else:  # the best sums lie among the best codes of either block
                sums = a[:few, None] + b[None, :few]
                rows, cols = np.divmod(np.argsort(-sums, axis=None)[:FEWEST], sums.shape[1])
            out.append((k * self.size + o1[rows]) * self.size + o2[cols])
        return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def _decode(filters: Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000):
            x = _matrix(b["v"])
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            found = filters.decode(x)
            yield pa.RecordBatch.from_pydict({"id": b["id"], "label": b["label"], "v": b["v"], "filters": pa.array(found, pa.list_(pa.int64()))})

    return run


def _links(least: float):
    """Over rows that come sorted by unit of work (label, filter, and two blocks)."""

    def unit(rows: pa.Table) -> pa.RecordBatch:
        x, ids, side = _matrix(rows["v"]), rows["id"].to_numpy(), rows["block"].to_numpy()
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ok = np.triu(x @ x.T >= least, 1)
        if rows["bi"][0].as_py() != rows["bj"][0].as_py():
            ok &= side[:, None] != side[None, :]
        i, j = np.nonzero(ok)
        if len(i):  # pairs that also meet in an earlier filter are left to it
            lists = rows["before"].combine_chunks()
            filters, at = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            row = np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy()))
            met = np.zeros(len(i), bool)
            for lo in range(0, len(filters), 4096):
                some = (at >= lo) & (at < lo + 4096)
                has = np.zeros((len(x), min(4096, len(filters) - lo)), np.float32)
                has[row[some], at[some] - lo] = 1
                met |= (has @ has.T)[i, j] > 0
            i, j = i[~met], j[~met]
        a, b = ids[i], ids[j]
        return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            keys = np.stack([t[c].to_numpy().astype(np.int64) for c in ("label", "f", "bi", "bj")])
            starts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if j - i > 1:
                    yield unit(t.slice(i, j - i))
            held = t.slice(starts[-1])  # the last unit may go on in the next batch
        if held is not None and held.num_rows > 1:
            yield unit(held)

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93) -> DataFrame:
    """Link vectors of equal labels with cosine ``least`` or more, and report their components.

    Equal vectors of a label are first taken as one. Each of the others is list-decoded to the
    filters whose spherical cap it lies in; vectors meet in their common filters, and the cosine
    is then taken in double precision on the original components. A pair is reported by the first
    filter that both have. Buckets of more than ``BLOCK``
    vectors are split, and every two blocks meet in a unit of work of their own, so a large group
    neither gathers in one task nor is cut. The number of filters follows the size of the
    largest label, which keeps chance meetings per vector constant as the table grows. No vector
    is capped or left out: a vector in few caps takes its best filters instead.

    Returns a row per input row: ``vec_id, n_links, component_id, kept``. Vectors that are null,
    zero, hold null or non-finite components or have a null label, and rows with a null id, link
    with nothing; the latter have a null component and are kept. Rows that share an id and a
    vector are copies of each other; rows that share an id but no vector are one vector that links
    through both. An empty table gives no row. All vectors must have one length. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("long").alias("label"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull() & F.col("id").isNotNull())
    keyed = rows.withColumns({"k1": F.xxhash64("v"), "k2": F.hash("v")})
    classes = scratch.cut(keyed.filter("ok").groupBy("label", "k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("v").alias("v")))
    top = classes.groupBy("label").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).agg(F.max("n"), F.max("dim")).first()
    filters = Filters(top[1] or 2, top[0] or 1, least)
    listed = scratch.cut(classes.select("id", "label", "v").mapInArrow(_decode(filters), f"id long, label long, v {dict(vectors.dtypes)[vector_col]}, filters array<long>"))
    # each row also has the filters before its own, by which a pair is reported once
    spread = listed.select("id", "label", "v", "filters", F.posexplode("filters").alias("p", "f")).select("id", "label", "v", "f", F.slice("filters", F.lit(1), F.col("p")).alias("before"))
    hot = scratch.cut(spread.groupBy("label", "f").agg(F.count("*").alias("c")).filter(F.col("c") > BLOCK).select("label", "f", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")))
    if hot.isEmpty():
        units = spread.select("*", F.lit(0).alias("block"), F.lit(0).alias("bi"), F.lit(0).alias("bj"))
    else:
        units = spread.join(hot, ["label", "f"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        units = units.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        units = units.select("id", "label", "v", "f", "before", "block", F.least("block", "o").alias("bi"), F.greatest("block", "o").alias("bj"))
    dealt = units.repartition("label", "f", "bi", "bj").sortWithinPartitions("label", "f", "bi", "bj")
    links = scratch.cut(dealt.mapInArrow(_links(least), "a long, b long").distinct())
    comps = components(scratch, links)
    # links of a class: its other copies, and all copies of the classes it is linked with
    weight = scratch.cut(classes.groupBy("id").agg(F.sum("n").alias("n")))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    degree = both.join(weight.select(F.col("id").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("others"))
    told = weight.join(degree.withColumnRenamed("a", "id"), "id", "left").join(comps, "id", "left")
    told = told.select(F.col("id").alias("rep"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    part = scratch.cut(classes.select("label", "k1", "k2", F.col("id").alias("rep")).join(told, "rep").select("label", "k1", "k2", "n_links", "component_id"))
    scratch.keep(part)
    good = keyed.filter("ok").select("id", "label", "k1", "k2").join(part, ["label", "k1", "k2"]).select("id", "n_links", "component_id")
    rest = keyed.filter("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return good.unionByName(rest).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
