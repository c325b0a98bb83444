"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched by beams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.caps import usable
from auditlake.llm.common import Scratch

#: Points at which every search begins, at least.
ENTRIES = 32
#: Decimals of unit vectors that points of one node have in common.
_DIGITS = 7


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)


def beam_search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Greedy beam searches of all rows of ``q`` at once; nodes by descending cosine, and the cosines.

    ``x`` and ``q`` hold unit vectors, ``edges`` the neighbours of each node (-1: none). Each step
    expands the nearest few unexpanded nodes of every beam, until no beam has any left.
    """
    n, m = len(x), len(q)
    seen = np.zeros((m, n), bool)
    ids, sims = np.full((m, beam), -1, np.int32), np.full((m, beam), -np.inf)
    k = min(len(entries), beam)
    first = q @ x[entries].T
    order = np.argsort(-first, axis=1, kind="stable")[:, :k]
    ids[:, :k], sims[:, :k] = entries[order], np.take_along_axis(first, order, 1)
    seen[:, entries] = True
    done = ids < 0
    active = np.arange(m)
    while len(active):
        open_ = ~done[active]
        pick = open_ & (np.cumsum(open_, axis=1) <= expand)
        row, col = np.nonzero(pick)
        if not len(row):
            break
        done[active[row], col] = True
        near = edges[ids[active[row], col]]
        r, c = np.repeat(active[row], near.shape[1]), near.ravel()
        ok = c >= 0
        r, c = r[ok], c[ok]
        fresh = ~seen[r, c]
        code = np.unique(r[fresh] * np.int64(n) + c[fresh])
        r, c = code // n, code % n
        seen[r, c] = True
        s = np.einsum("ij,ij->i", x[c], q[r])
        good = s > sims[r, -1]
        r, c, s = r[good], c[good], s[good]
        rows, first, count = np.unique(r, return_index=True, return_counts=True)
        if len(rows):
            at = np.arange(len(r)) - np.repeat(first, count)
            new_ids, new_sims = np.full((len(rows), count.max()), -1, np.int32), np.full((len(rows), count.max()), -np.inf)
            where = np.repeat(np.arange(len(rows)), count)
            new_ids[where, at], new_sims[where, at] = c, s
            all_ids, all_sims = np.hstack([ids[rows], new_ids]), np.hstack([sims[rows], new_sims])
            all_done = np.hstack([done[rows], new_ids < 0])
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[rows], sims[rows], done[rows] = (np.take_along_axis(a, top, 1) for a in (all_ids, all_sims, all_done))
        active = active[(~done[active]).any(1)]
    return ids, sims


def robust_prune(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each row of candidates (nearest first, -1: none) the diverse ones that stay.

    The nearest candidate stays; one that is ``relax`` times nearer to it than to the row's own
    point goes, as a search will reach it through the one that stays; and so on. Distances are
    squared Euclidean ones of unit vectors, so ``relax`` is squared too.
    """
    v = x[np.maximum(cand, 0)]
    apart = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
    own = 2 - 2 * sims
    alive = cand >= 0
    out = np.full((len(cand), degree), -1, np.int32)
    rows = np.arange(len(cand))
    for k in range(degree):
        has = alive.any(1)
        if not has.any():
            break
        j = alive.argmax(1)
        out[has, k] = cand[rows[has], j[has]]
        alive &= ~((relax * apart[rows, j] <= own) & has[:, None])
        alive[rows, j] = False
    return out


def far_points(x: np.ndarray, n: int) -> np.ndarray:
    """The point nearest to the middle, then always the one farthest from those chosen."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[chosen[0]]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return np.unique(chosen).astype(np.int32)


def reached(edges: np.ndarray, start: np.ndarray, seen: np.ndarray) -> None:
    """Mark all nodes to which edges lead from ``start``."""
    seen[start] = True
    while len(start):
        to = np.unique(edges[start])
        start = to[to >= 0]
        start = start[~seen[start]]
        seen[start] = True


def build_graph(x: np.ndarray, degree: int = 32, beam: int = 64, relax: float = 1.2, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Edges (-1: none) and entry points of a robust-pruned graph over unit vectors.

    Points come in batches in random order. A beam search on the graph so far proposes the
    neighbours of each, pruning keeps diverse ones, and the edges are added backwards too, pruning
    again where a node has too many. A second round over all points uses the relaxed distance.
    Entries are far from each other; wherever edges lead nowhere from them, a point becomes one too.
    """
    n = len(x)
    rng = np.random.default_rng(seed)
    edges = np.full((n, degree), -1, np.int32)
    entries = far_points(x, ENTRIES)

    def connect(batch: np.ndarray, slack: float) -> None:
        ids, sims = beam_search(x, edges, entries, x[batch], beam)
        mine = ids == batch[:, None]
        old = edges[batch]
        extra = np.where((old[:, :, None] == ids[:, None, :]).any(2), -1, old)
        ids, sims = np.hstack([np.where(mine, -1, ids), extra]), np.hstack([sims, np.einsum("ijk,ik->ij", x[np.maximum(extra, 0)], x[batch])])
        sims = np.where(ids >= 0, sims, -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        edges[batch] = robust_prune(x, np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), degree, slack)
        # backwards
        to, frm = edges[batch].ravel(), np.repeat(batch, degree)
        to, frm = to[to >= 0], frm[to >= 0]
        fresh = ~(edges[to] == frm[:, None]).any(1)
        to, frm = to[fresh], frm[fresh]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        for lo in range(0, len(nodes), 512):
            some, many = nodes[lo : lo + 512], count[lo : lo + 512]
            add = np.full((len(some), many.max()), -1, np.int32)
            a, b = first[lo], first[lo] + many.sum()
            add[np.repeat(np.arange(len(some)), many), np.arange(b - a) - np.repeat(first[lo : lo + 512] - a, many)] = frm[a:b]
            cand = np.hstack([edges[some], add])
            near = np.where(cand >= 0, np.einsum("ijk,ik->ij", x[np.maximum(cand, 0)], x[some]), -np.inf)
            order = np.argsort(-near, axis=1, kind="stable")
            cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
            size = (cand >= 0).sum(1)
            fits = size <= degree
            width = min(degree, cand.shape[1])
            edges[some[fits], :width] = cand[fits, :width]
            edges[some[~fits]] = robust_prune(x, cand[~fits], near[~fits], degree, slack)

    order = rng.permutation(n).astype(np.int32)
    for slack in (1.0, relax * relax):
        at, step = 0, 8
        while at < n:
            connect(order[at : at + step], slack)
            at += step
            step = min(256, max(8, at // 4)) if slack == 1.0 else 256
    seen = np.zeros(n, bool)
    reached(edges, entries, seen)
    while not seen.all():
        more = np.flatnonzero(~seen)[:1].astype(np.int32)
        entries = np.append(entries, more)
        reached(edges, more, seen)
    return edges, entries


def _groups(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """The number of each row among the distinct ones, and how many there are."""
    distinct, back = np.unique(keys, axis=0, return_inverse=True)
    return back.ravel(), len(distinct)


def _index(degree: int, beam: int, relax: float, keep: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, raw = table["id"].to_numpy(), matrix(table["v"])
        # of equal vectors the smallest ids
        same, _ = _groups(raw)
        order = np.argsort(same, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]]))
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        rows = np.sort(order[place < keep])
        ids, raw = ids[rows], raw[rows]
        unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
        node, n = _groups(np.round(unit, _DIGITS) + 0.0)
        head = np.full(n, len(node))
        np.minimum.at(head, node, np.arange(len(node)))
        edges, entries = build_graph(unit[head], degree, beam, relax)
        heads = np.isin(np.arange(len(node)), head)
        lists = [edges[i] if h else None for i, h in zip(node.tolist(), heads.tolist(), strict=True)]
        return pa.table({"shard": pa.array([table["shard"][0].as_py()] * len(node), pa.int32()), "node": pa.array(node, pa.int32()), "entry": pa.array(heads & np.isin(node, entries)), "id": pa.array(ids, pa.int64()), "v": pa.array(list(raw), pa.list_(pa.float64())), "edges": pa.array(lists, pa.list_(pa.int32()))})

    return run


def _search(beam: int, k: int):
    def run(graph: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_id, out_s = [], [], []
        if graph.num_rows and queries.num_rows:
            # rows of a node one after the other, the one with the edges first
            graph = graph.append_column("rest", pa.array(graph["edges"].is_null())).sort_by([("node", "ascending"), ("rest", "ascending"), ("id", "ascending")])
            raw, ids, node = matrix(graph["v"]), graph["id"].to_numpy(), graph["node"].to_numpy()
            norm = np.sqrt((raw * raw).sum(1))
            start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            size = np.diff(np.append(start, len(node)))
            x = raw[start] / norm[start, None]
            edges = graph["edges"].combine_chunks().drop_null().flatten().to_numpy().reshape(len(x), -1)
            entries = np.flatnonzero(graph["entry"].to_numpy()[start]).astype(np.int32)
            own, q = queries["id"].to_numpy(), matrix(queries["v"])
            q_norm = np.sqrt((q * q).sum(1))
            for lo in range(0, len(q), 256):
                found, _ = beam_search(x, edges, entries, q[lo : lo + 256] / q_norm[lo : lo + 256, None], beam)
                for i, nodes in enumerate(found, lo):
                    nodes = nodes[nodes >= 0]
                    n = size[nodes]
                    rows = np.repeat(start[nodes] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                    rows = rows[ids[rows] != own[i]]
                    score = (raw[rows] * q[i]).sum(1) / (norm[rows] * q_norm[i])
                    best = np.lexsort((ids[rows], -score))
                    # an id may have several vectors
                    best = best[np.sort(np.unique(ids[rows][best], return_index=True)[1])[:k]]
                    out_q += [own[i]] * len(best)
                    out_id += ids[rows][best].tolist()
                    out_s += score[best].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_id, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, shard_rows: int = 8192, query_rows: int = 4096, degree: int = 32, beam: int = 128, build_beam: int = 64, relax: float = 1.2) -> DataFrame:
    """The ``k`` nearest found for each query among all vectors but its own, by cosine.

    Vectors are dealt by a hash to shards of about ``shard_rows``. A task builds the graph of a
    shard and writes it to the shared folder. Vectors of one direction (to seven decimals) are one
    node with all their ids, of equal vectors the ``k + 1`` smallest ids, as no other copy can be
    among the ``k`` nearest. Searches begin at points far from each other, and at one point of every
    part that edges don't lead to. Every block of ``query_rows`` queries searches every shard in a
    unit of work of its own, so neither the index nor the query set has to fit a task, and the
    results of the shards are merged. All ids of all nodes that a beam ends with are scored, by the
    cosine in double precision of the original vectors.

    Returns ``query_id, rank, vec_id, score``, nearest first, ties to the smaller id. Vectors that
    are null, zero or hold null or non-finite components, and rows with a null id, take no part.
    Of queries that share an id one is answered; of searched vectors that share an id, the nearest
    one counts. All vectors must have one length. Without vectors or queries there is no row.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    clean = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    base, asked = clean(vectors), scratch.cut(clean(queries).dropDuplicates(["id"]))
    shards, blocks = -(-max(1, base.count()) // shard_rows), -(-max(1, asked.count()) // query_rows)
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    graph = scratch.cut(dealt.repartitionById(shards, "shard").groupBy("shard").applyInArrow(_index(degree, build_beam, relax, k + 1), "shard int, node int, entry boolean, id long, v array<double>, edges array<int>"))
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = graph.withColumn("part", all_(blocks))
    right = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", all_(shards))
    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(_search(beam, k), "query_id long, vec_id long, score double")
    found = scratch.cut(found)
    scratch.keep(found)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
