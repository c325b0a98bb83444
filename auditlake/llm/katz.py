"""Language-model scores from a Katz backoff model with Good-Turing discounts.

Counting and scoring exchange blocks of keys instead of a row per token: a chunk of documents
sends every partition of the n-gram table its distinct n-grams once, with their counts, and gets
one answer for each. So frequent words weigh no more than rare ones in any exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, mix, slices, split_words, word_hashes
from auditlake.llm.langid import held_out

#: Tokens of a chunk, and of a partition of the n-gram table, on average.
CHUNK, PART = 1_000_000, 2_000_000
#: Histories seen more often than this are split over partitions by the words that follow them.
HOT = 500_000
#: Counts up to this one are discounted.
TOP = 5
#: What every history is taken to have been followed by more often than it was, so that unseen
#: words keep some chance even where no count is discounted.
ESCAPE = 0.1
#: The key of the end of a document.
_END = np.uint64(0x1F83D9ABFB41BD6B)
#: Numbers of words: unseen ones, and what stands before the first word of a document; others follow.
_UNSEEN, _START, _FIRST = 0, 1, 2
#: Rows told to nobody hold statistics.
_NOBODY = -1


def squeeze(a: np.ndarray) -> bytes:
    """Integers or floats as compressed byte planes."""
    return pa.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b"", codec="zstd", asbytes=True)


def expand(data: bytes, n: int, dtype: str) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    if not n:
        return np.empty(0, dtype)
    raw = np.frombuffer(pa.decompress(data, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).reshape(-1).view(dtype)


_CHUNK = "chunk long, tokens long, types long, ids array<long>, held array<boolean>, sizes array<long>, keys binary, stream binary"


def _chunks(most: int):
    """A row per million tokens or so: the documents, their distinct words' hashes, and the words as numbers among those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0

        def new() -> tuple:
            return {}, [], [], [], [], []

        def row(local: dict, stream: list, ids: list, held: list, sizes: list, words: list) -> pa.RecordBatch:
            # words whose hashes meet are one word
            keys, at = np.unique(np.concatenate([np.array([_END]), word_hashes(words)]), return_inverse=True)
            tokens = at[np.concatenate(stream)].astype("<u4")
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([(part << 24) + number], pa.int64()), "tokens": pa.array([len(tokens)], pa.int64()), "types": pa.array([len(keys)], pa.int64()),
                "ids": pa.array([ids], pa.list_(pa.int64())), "held": pa.array([held], pa.list_(pa.bool_())), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                "keys": pa.array([squeeze(np.diff(keys, prepend=np.uint64(0)))], pa.binary()), "stream": pa.array([squeeze(tokens)], pa.binary()),
            })

        local, stream, ids, held, sizes, words = new()
        total = 0
        for b in slices(batches, 200):
            for i, h, text in zip(b["id"].to_pylist(), b["held"].to_pylist(), b["text"].to_pylist(), strict=True):
                own = split_words(text)
                fresh = set(own).difference(local)
                for w in fresh:
                    local[w] = len(local) + 1
                words += fresh
                stream.append(np.array([*map(local.__getitem__, own), 0], np.int32))
                ids.append(i)
                held.append(h)
                sizes.append(len(own) + 1)
                total += len(own) + 1
                if total >= most:
                    yield row(local, stream, ids, held, sizes, words)
                    local, stream, ids, held, sizes, words = new()
                    total, number = 0, number + 1
        if ids:
            yield row(local, stream, ids, held, sizes, words)

    return run


_ASK = "part int, level int, chunk long, n long, keys binary, data array<binary>"
_ASK_ARROW = pa.schema([("part", pa.int32()), ("level", pa.int32()), ("chunk", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("data", pa.list_(pa.binary()))])
_TELL = "chunk long, level int, part int, n long, m long, data array<binary>, stats array<long>, hist long, mass array<double>"
_TELL_ARROW = pa.schema([("chunk", pa.int64()), ("level", pa.int32()), ("part", pa.int32()), ("n", pa.int64()), ("m", pa.int64()), ("data", pa.list_(pa.binary())), ("stats", pa.list_(pa.int64())), ("hist", pa.int64()), ("mass", pa.list_(pa.float64()))])


def _tell(**row) -> dict:
    return dict.fromkeys(_TELL_ARROW.names) | row


@dataclass
class Level:
    """What is known of the n-grams of one length: their total and number, the discount factors of their counts, and how many were seen 1 to ``TOP`` times."""

    total: int
    types: int
    cut: np.ndarray
    of: list[int]

    def kept(self, n: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return self.cut[np.minimum(n, TOP + 1) % (TOP + 1)] * n

    def left(self, history: np.ndarray, of: np.ndarray) -> np.ndarray:
        """What the continuations of histories leave to unseen ones, from how many of them were seen 1 to ``TOP`` times."""
        counts = np.arange(1, TOP + 1)
        return (((1 - self.cut[1:]) * counts * of).sum(-1) + ESCAPE) / (history + ESCAPE)


class _Chunk:
    """A chunk row unpacked, with what was told of its words and n-grams so far.

    Items of ``told`` have, for each level, the count of the n-gram that every token ends
    (``n``), and where that is 0 though the history was seen, the history's backoff weight (else 1).
    """

    def __init__(self, r: dict, told: list[dict], levels: list[Level], wide: bool, hot: int = HOT):
        self.chunk, t, self.types = r["chunk"], r["tokens"], r["types"]
        self.keys = np.cumsum(expand(r["keys"], self.types, "<u8"), dtype=np.uint64)
        self.tokens = expand(r["stream"], t, "<u4").astype(np.int64)
        self.ids, self.held, self.sizes = r["ids"], np.array(r["held"], bool), np.array(r["sizes"], np.int64)
        self.train = np.repeat(~self.held, self.sizes)
        self.start = np.cumsum(self.sizes) - self.sizes
        self.levels, self.wide, self.hot = levels, wide, hot
        self.told = {}
        for a in told:
            self.told.setdefault(a["level"], []).append(a)
        if not levels:
            return
        # words in the order of their numbers, so that whatever is sorted by them is sorted by numbers
        answers = sorted(self.told.get(1, []), key=lambda a: a["part"])
        where = np.argsort(_word_part(self.keys, answers[0]["m"]), kind="stable")
        number, count = np.empty(self.types, np.int64), np.empty(self.types, np.int64)
        number[where] = np.concatenate([expand(a["data"][0], a["n"], "<u8") for a in answers])
        count[where] = np.concatenate([expand(a["data"][1], a["n"], "<u8") for a in answers])
        self.documents = int(count[np.searchsorted(self.keys, _END)])
        order = np.argsort(number, kind="stable")
        rank = np.empty(self.types, np.int64)
        rank[order] = np.arange(self.types)
        self.tokens, self.number, self.count = rank[self.tokens], number[order], count[order]
        self.low = self.count[self.tokens]  # count of the n-gram of the level below that each token ends
        self.weight = []
        # the history of the level: its number among the chunk's, its key, and how often it was seen
        self.at = self._before(self.tokens + 1, 0)
        self.hist_key, self.hist_count = np.concatenate([[_START], self.number]).astype(np.uint64), np.concatenate([[self.documents], self.count])
        self.below = np.full(self.types + 1, self.levels[0].total)  # count of the history without its first word
        self.m = 2

    def _before(self, values: np.ndarray, first: int) -> np.ndarray:
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.start] = first
        return out

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The n-grams of the level with a history that was seen: history, word (-1: unseen after the shorter history), and for each token its n-gram, or -1."""
        some = np.flatnonzero(self.hist_count[self.at] > 0)
        word = np.where(self.low[some] > 0, self.tokens[some], -1)
        codes, at = np.unique(self.at[some] * (self.types + 1) + word + 1, return_inverse=True)
        full = np.full(len(self.tokens), -1, np.int64)
        full[some] = at
        hist, word = np.divmod(codes, self.types + 1)
        return hist, word - 1, full, some

    def ask(self, parts: int) -> Iterator[dict]:
        hist, word, full, some = self.distinct()
        numbers = np.where(word < 0, _UNSEEN, self.number[np.maximum(word, 0)])
        seen = np.bincount(full[some][self.train[some]], minlength=len(hist)).astype("<u4")
        low = np.zeros(len(hist), np.int64)
        low[full[some]] = self.low[some]
        keys, counts = self.hist_key[hist], self.hist_count[hist]
        part = _part(keys, counts, numbers, parts, self.hot)
        by = np.argsort(part, kind="stable")
        ends = np.cumsum(np.bincount(part, minlength=parts))
        for p, (i, j) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
            if j > i:
                own = by[i:j]
                first = np.flatnonzero(np.concatenate([[True], keys[own][1:] != keys[own][:-1]]))
                data = [np.diff(np.append(first, len(own))).astype("<u4"), numbers[own].astype("<u8"), seen[own], low[own].astype("<u8"), (counts[own][first] > self.hot).astype("u1")]
                yield {"part": p, "level": self.m, "chunk": self.chunk, "n": len(own), "keys": squeeze(np.diff(keys[own][first], prepend=np.uint64(0))), "data": [np.array([len(first)], "<i8").tobytes(), *map(squeeze, data)]}

    def take(self, parts: int) -> None:
        """Take what was told of the level, and go on to the next one."""
        hist, word, full, some = self.distinct()
        level, below = self.levels[self.m - 1], self.levels[self.m - 2]
        numbers = np.where(word < 0, _UNSEEN, self.number[np.maximum(word, 0)])
        own = self.told.get(self.m, [])
        answers = sorted((a for a in own if a["hist"] is None), key=lambda a: a["part"])
        n = np.empty(len(hist), np.int64)
        by = np.argsort(_part(self.hist_key[hist], self.hist_count[hist], numbers, parts, self.hot), kind="stable")
        n[by] = np.concatenate([np.empty(0, np.int64), *(expand(a["data"][0], a["n"], "<u8").astype(np.int64) for a in answers)])
        # histories of unseen n-grams, of either kind
        keys = np.concatenate([np.empty(0, np.uint64), *(np.cumsum(expand(a["data"][1], a["m"], "<u8"), dtype=np.uint64) for a in answers), np.array([a["hist"] for a in own if a["hist"] is not None], np.int64).view(np.uint64)])
        of = [np.concatenate([np.empty(0), *(expand(a["data"][2 + i], a["m"], "<f8" if i == TOP else "<u4") for a in answers), np.array([a["mass"][i] for a in own if a["hist"] is not None], float)]) for i in range(TOP + 1)]
        weight = np.ones(len(hist))
        if len(keys):
            order = np.argsort(keys)
            keys, of = keys[order], [x[order] for x in of]
            missing = np.flatnonzero(n == 0)
            h = hist[missing]
            at = np.searchsorted(keys, self.hist_key[h])
            weight[missing] = level.left(self.hist_count[h], np.stack(of[:TOP], -1)[at]) / (1 - of[TOP][at] / (self.below[h] + ESCAPE))
        count = np.where(full >= 0, n[full], 0) if len(hist) else np.zeros(len(full), np.int64)
        history = self.hist_count[self.at]
        self.weight.append((history, count, np.where(full >= 0, weight[full], 1.0) if len(hist) else np.ones(len(full))))
        below = np.zeros(len(hist), np.int64)
        below[full[some]] = self.low[some]
        longer = self._longer(self.hist_key[hist], numbers)
        self.below = np.concatenate([[self.documents], below, [0]])
        self.hist_key = np.concatenate([self._longer(self.hist_key[:1], np.array([_START])), longer, np.zeros(1, np.uint64)])
        self.hist_count = np.concatenate([[self.documents], n, [0]])
        self.at = self._before(np.where(full >= 0, full + 1, len(hist) + 1), 0)
        self.low = count
        self.m += 1

    def _longer(self, keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Keys of histories with one more word at the end; two numbers fit a key if there are not too many words."""
        numbers = numbers.astype(np.uint64)
        return mix(mix(keys) ^ numbers) if self.m > 2 or self.wide else (keys << np.uint64(32)) | numbers

    def logs(self) -> np.ndarray:
        """log10 of the chance of every token."""
        one = self.levels[0]
        unseen = one.left(np.array(one.total), np.array(one.of))
        n = self.count[self.tokens]
        chance = np.where(n > 0, one.kept(n) / (one.total + ESCAPE), unseen)
        for level, (history, n, weight) in zip(self.levels[1:], self.weight, strict=True):
            chance = np.where(n > 0, level.kept(n) / (history + ESCAPE), weight * chance)
        return np.log10(chance)


def _word_part(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys % np.uint64(parts)).astype(np.int64)


def _part(keys: np.ndarray, counts: np.ndarray, numbers: np.ndarray, parts: int, most: int) -> np.ndarray:
    """Partitions of n-grams: that of the history, and for hot histories one of several, by the word."""
    hot = counts > most
    out = mix(keys)
    if hot.any():
        spread = np.minimum(counts[hot] // most + 1, parts).astype(np.uint64)
        out[hot] += mix(numbers[hot].astype(np.uint64)) % spread
    out %= np.uint64(parts)
    return out.astype(np.uint16 if parts <= 1 << 16 else np.int64)


def _ask_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                c = _Chunk(r, [], [], False)
                seen = np.bincount(c.tokens[c.train], minlength=c.types).astype("<u4")
                part = _word_part(c.keys, parts)
                by = np.argsort(part, kind="stable")
                ends = np.cumsum(np.bincount(part, minlength=parts))
                rows = [{"part": p, "level": 1, "chunk": c.chunk, "n": j - i, "keys": squeeze(np.diff(c.keys[by[i:j]], prepend=np.uint64(0))), "data": [squeeze(seen[by[i:j]])]} for p, (i, j) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)) if j > i]
                yield pa.RecordBatch.from_pylist(rows, schema=_ASK_ARROW)

    return run


def _statistics(level: int, total: np.ndarray) -> dict:
    counts = np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)
    return _tell(chunk=_NOBODY, level=level, stats=[int(total.sum()), int((total > 0).sum()), *counts[1 : TOP + 2].tolist()])


def _count_words(parts: int):
    """Numbers and training counts of a partition's words, told to every chunk that asked; frequent words have small numbers."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys, at = np.unique(np.concatenate([np.cumsum(expand(r["keys"], r["n"], "<u8"), dtype=np.uint64) for r in rows]), return_inverse=True)
        total = np.bincount(at, np.concatenate([expand(r["data"][0], r["n"], "<u4") for r in rows]), len(keys)).astype(np.int64)
        number = np.empty(len(keys), np.int64)
        number[np.lexsort((keys, -total))] = np.arange(len(keys)) * parts + rows[0]["part"] + _FIRST
        number[total == 0] = _UNSEEN
        out, i = [_statistics(1, total)], 0
        for r in rows:
            own = at[i : i + r["n"]]
            out.append(_tell(chunk=r["chunk"], level=1, part=r["part"], n=r["n"], m=parts, data=[squeeze(number[own].astype("<u8")), squeeze(total[own].astype("<u8"))]))
            i += r["n"]
        return pa.Table.from_pylist(out, schema=_TELL_ARROW)

    return run


def _count(below: Level):
    """Training counts of a partition's n-grams, told to every chunk that asked.

    Where an n-gram was never seen, the asker also gets what its history's backoff weight takes:
    how many continuations were seen 1 to ``TOP`` times, and the discounted counts of all seen
    ones after the shorter history, added up. Of a hot history those are only this partition's
    share; they go into rows without a chunk, and askers into rows without shares.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        firsts = [int(np.frombuffer(r["data"][0], "<i8")[0]) for r in rows]
        level = rows[0]["level"]
        mine = [np.cumsum(expand(r["keys"], f, "<u8"), dtype=np.uint64) for r, f in zip(rows, firsts, strict=True)]
        keys, hist = np.unique(np.concatenate(mine), return_inverse=True)
        hist = hist.astype(np.int64)
        hot = np.zeros(len(keys), bool)
        hot[hist] = np.concatenate([expand(r["data"][5], f, "u1") for r, f in zip(rows, firsts, strict=True)]) > 0
        spans = np.concatenate([expand(r["data"][1], f, "<u4") for r, f in zip(rows, firsts, strict=True)])
        word, seen, low = (np.concatenate([expand(r["data"][i], r["n"], t) for r in rows]).astype(np.int64) for i, t in ((2, "<u8"), (3, "<u4"), (4, "<u8")))
        hist = np.repeat(hist, spans)
        kinds, w = np.unique(word, return_inverse=True)
        codes, first, at = np.unique(hist * len(kinds) + w, return_index=True, return_inverse=True)
        total = np.bincount(at, seen, len(codes)).astype(np.int64)
        of_hist = hist[first]
        shares = [np.bincount(of_hist[total == n], minlength=len(keys)) for n in range(1, TOP + 1)]
        shares.append(np.bincount(of_hist, below.kept(low[first]) * (total > 0), len(keys)))
        out, i = [_statistics(level, total)], 0
        for r in rows:
            n = total[at[i : i + r["n"]]]
            missing = np.unique(hist[i : i + r["n"]][n == 0])
            for h in missing[hot[missing]].tolist():
                out.append(_tell(chunk=r["chunk"], level=level, hist=int(keys[h].astype(np.int64))))
            missing = missing[~hot[missing]]
            data = [squeeze(n.astype("<u8")), squeeze(np.diff(keys[missing], prepend=np.uint64(0))), *(squeeze(x[missing].astype("<u4")) for x in shares[:TOP]), squeeze(shares[TOP][missing])]
            out.append(_tell(chunk=r["chunk"], level=level, part=r["part"], n=r["n"], m=len(missing), data=data))
            i += r["n"]
        for h in np.flatnonzero(hot).tolist():
            out.append(_tell(chunk=_NOBODY, level=level, hist=int(keys[h].astype(np.int64)), mass=[float(x[h]) for x in shares]))
        return pa.Table.from_pylist(out, schema=_TELL_ARROW)

    return run


def discounts(of: list[int], top: int = TOP) -> np.ndarray:
    """Factors for the counts 0 to ``top`` (0: unused) from the numbers of keys seen 1 to ``top + 1`` times.

    Katz's Good-Turing factors for the largest ``top`` at which all are proper; where none is
    (tiny tables), absolute discounting by ``n1 / (n1 + 2 n2)``, or a half if nothing was seen once.
    """
    for k in range(top, 0, -1):
        n = [0, *of]
        if all(n[1 : k + 2]):
            tail = (k + 1) * n[k + 1] / n[1]
            d = np.array([((r + 1) * n[r + 1] / n[r] / r - tail) / (1 - tail) if tail < 1 else 0 for r in range(1, k + 1)])
            if ((d > 0) & (d < 1)).all():
                return np.concatenate([[1], d, np.ones(top - k)])
    cut = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5
    cut = min(max(cut, 0.1), 0.9)
    return np.array([1] + [(r - cut) / r for r in range(1, top + 1)])


def _opened(chunks: pa.Table, told: pa.Table, levels: list[Level], wide: bool, parts: int, hot: int) -> Iterator[_Chunk]:
    answers = told.to_pylist()
    for r in chunks.to_pylist():
        c = _Chunk(r, answers, levels, wide, hot)
        while c.m <= len(levels):
            c.take(parts)
        yield c


def _ask(levels: list[Level], wide: bool, parts: int, hot: int):
    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        return pa.Table.from_pylist([row for c in _opened(chunks, told, levels, wide, parts, hot) for row in c.ask(parts)], schema=_ASK_ARROW)

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(levels: list[Level], wide: bool, parts: int, hot: int):
    def run(chunks: pa.Table, told: pa.Table) -> pa.Table:
        out, one = [], levels[0]
        for c in _opened(chunks, told, levels, wide, parts, hot):
            n = c.count[c.tokens]
            base = np.log10((n + 1.0) / (one.total + one.types + 1.0))
            sums = [np.add.reduceat(v, c.start) for v in (base, c.logs(), (n > 0).astype(np.int64))]
            out.append(pa.table({"doc_id": pa.array(c.ids, pa.int64()), "held_out": c.held, "n_tokens": c.sizes, "n_known": sums[2], "train_tokens": np.full(len(c.sizes), one.total), "base_score": sums[0], "score": sums[1]}))
        return pa.concat_tables(out)

    return run


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, part: int = 2, order: int = 3, chunk_tokens: int = CHUNK, part_tokens: int = PART, hot: int = HOT) -> DataFrame:
    """Score every whole text with a model of ``order`` (2 or more) of the documents that are not held out.

    Tokens are words with A-Z lowered, then one end; the first word stands after ``order - 1``
    starts. An n-gram that was seen has its Good-Turing discounted count, divided by the count of
    its history and ``ESCAPE``; any other has the history's backoff weight times the chance after
    the history without its first word, and so on down to the word's own chance; a history that
    was never seen has weight one. Words have discounted shares too, and what is left is the chance
    of any unseen word. A history's weight is what its seen continuations leave, divided by what
    they leave after the shorter history, so chances after every history add up to one, and none is 0.

    Words are numbered first, by falling count within a partition. Then, order by order, n-grams go
    to the partition of their history, where their count and all that its weight takes meet.
    Histories seen more than ``hot`` times are spread by the next word, and their shares are added
    up. A chunk of about ``chunk_tokens`` asks only for n-grams whose history was seen; a partition of
    the table has about ``part_tokens``.

    Documents are held out if crc32 of the id's text mod ``parts`` is ``part``; a null id is not.
    Returns a row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score``, scores being sums of log10. Null texts count as empty: the end alone. Repeated rows
    are learned from and scored each. With nothing to learn from, all tokens are unseen words of
    chance one. An empty table gives no row. Counts and statistics are taken over all training documents.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col, parts, part).alias("held"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    buckets = 1 + ((size[0] or 0) + size[1]) // (8 * chunk_tokens)
    chunks = scratch.bucketed(rows.mapInArrow(_chunks(chunk_tokens), _CHUNK), "chunk", buckets)
    pieces = 1 + (chunks.agg(F.sum("tokens")).first()[0] or 0) // part_tokens
    levels: list[Level] = []
    wide, known = False, None
    for m in range(1, order + 1):
        if m == 1:
            asked = chunks.mapInArrow(_ask_words(pieces), _ASK)
        else:
            asked = chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_ask(levels, wide, pieces, hot), _ASK)
        told = scratch.cut(asked.groupBy("part").applyInArrow(_count_words(pieces) if m == 1 else _count(levels[-1]), _TELL))
        stats = told.filter("stats IS NOT NULL").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(TOP + 3)]).first()
        levels.append(Level(stats[0], stats[1], discounts(list(stats[2:])), list(stats[2 : TOP + 2])))
        if m == 1:  # numbers are below the largest partition's words times the partitions
            wide = stats[1] * 2 + pieces * 1000 >= 1 << 32
        # hot histories: shares are added up and go to those who asked
        sums = told.filter("mass IS NOT NULL").groupBy("hist").agg(F.array(*[F.sum(F.col("mass")[i]) for i in range(TOP + 1)]).alias("total"))
        askers = told.filter("hist IS NOT NULL AND mass IS NULL").select("chunk", "level", "hist").distinct()
        spread = askers.join(sums, "hist").select("chunk", "level", *[F.lit(None).cast(told.schema[c].dataType).alias(c) for c in ("part", "n", "m", "data", "stats")], "hist", F.col("total").alias("mass"))
        answers = told.filter(f"chunk <> {_NOBODY} AND hist IS NULL").unionByName(spread)
        known = answers if known is None else known.unionByName(answers)
    return chunks.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_scores(levels, wide, pieces, hot), _SCORED)
