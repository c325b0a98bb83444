"""Phrase mining by dynamic itemset counting: lengths interleaved in cyclic scans of shards."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, mix, slices

#: Words that a task holds at once, and words of a row of the table of hashed words.
HELD, ROW = 1_000_000, 30_000
#: Words whose hashes a task remembers.
KNOWN = 150_000
#: Words of a shard for each bucket of counts. A length has as many phrases as words at most, and the more text, the more of them are active.
BUCKET = 400_000
#: Bytes of counts of an Arrow batch: what a task sends at once lies outside of the JVM's heap as a whole, and more of it with more active phrases.
BATCH = 1_000_000
#: A-Z lowered, tab as space, the ends of pieces as one mark: no UTF-8 text has that byte.
_MARK = 0xFF
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else _MARK if c in b".,;:!?\n\v\f\r" else c for c in range(256))
_TOKENS = pa.schema([("lang", pa.string()), ("shard", pa.int32()), ("n", pa.int64()), ("tokens", pa.binary()), ("words", pa.list_(pa.string()))])
#: Counts of phrases of one language and length whose hashes fall into one bucket, as arrays side by side:
#: words (64-bit hashes), the step in which a phrase became active, how often it was counted.
_PART = [("lang", pa.string()), ("n", pa.int32()), ("bucket", pa.int64()), ("words", pa.binary()), ("since", pa.binary()), ("count", pa.binary())]
_FOUND = pa.schema([*_PART, ("old", pa.bool_())])
_MERGED = pa.schema([*_PART, ("over_words", pa.binary()), ("over_count", pa.binary()), ("fresh", pa.list_(pa.int32()))])
_PART_DDL = "lang string, n int, bucket long, words binary, since binary, count binary"


def _runs(cuts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The ranges between ``cuts``, in pieces of at most ``ROW`` words in phrases of ``n``."""
    most = max(1, ROW // n)
    return [(i, min(i + most, stop)) for start, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) for i in range(start, stop, most)]


def _batched(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some ``BATCH`` bytes, whose arrays are bytes or lists."""
    begin, size = 0, 0
    for i, r in enumerate(rows, 1):
        size += sum(len(x) for x in r if isinstance(x, (bytes, list)))
        if size >= BATCH or i == len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows[begin:i], strict=True), schema, strict=True)], schema=schema)
            begin, size = i, 0


class _Hashes(dict):
    """64-bit hashes of words, 0 for the end of a piece; ``new`` gathers words that were not known."""

    def __init__(self, salt: bytes):
        self.salt, self.new = salt, []
        self.forget()

    def forget(self) -> None:
        self.clear()
        self[bytes([_MARK])] = 0

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.forget()
        self[word] = h = xxhash.xxh64_intdigest(word + self.salt, seed=42) or 1
        self.new.append(word)
        return h


def _tokenised(shards: int, salt: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part, given = _Hashes(salt.encode()), TaskContext.get().partitionId(), {}
        held: dict[str, list[np.ndarray]] = {}
        size, mark = 0, bytes([_MARK])

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, arrays in held.items():
                whole = np.concatenate(arrays)
                ends = np.flatnonzero(whole == 0)  # the last word is an end
                at = 0
                while at < len(whole):
                    if at + ROW >= len(whole):
                        to = len(whole)
                    else:  # the last end that fits, or else the first one
                        k = np.searchsorted(ends, at + ROW)
                        to = int(ends[k - 1] if k and ends[k - 1] >= at else ends[k]) + 1
                    piece, at = whole[at:to], to
                    given[lang] = (given.get(lang, part - 1) + 1) % shards
                    # no more new words than words, so all of them are gone with the last row
                    new, hashes.new = hashes.new[: len(piece)], hashes.new[len(piece) :]
                    cells = [lang], [given[lang]], [int((piece != 0).sum())], [piece.tobytes()], [[w.decode("utf-8", "replace") for w in new]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _TOKENS, strict=True)], schema=_TOKENS)
            held.clear()
            if len(given) > HELD:
                given.clear()

        for b in slices(batches, 200):
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").translate(_FOLD).replace(mark, b" \xff ").split(b" ") if text else []
                tokens = np.fromiter((hashes[w] for w in words if w), np.uint64)
                if tokens.any():
                    held.setdefault(lang, []).append(np.append(tokens, np.uint64(0)))
                    size += len(tokens)
            if size >= HELD:
                yield from rows()
                size = 0
        yield from rows()

    return run


def _seed(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))


def _longer(acc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases that are one word longer."""
    return mix(acc * np.uint64(0x9E3779B97F4A7C15) + word)


def _grouped(words: np.ndarray, acc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal rows of ``words`` stand together, by hash, and where each group starts.

    Groups are told apart by their words, so that equal hashes of different phrases do no harm.
    """
    order = np.argsort(acc, kind="stable")
    sorted_ = words[order]
    return order, np.flatnonzero(np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(axis=1)]))


def _counted(sieve, step: int, shards: int, longest: int, buckets: int):
    """Counts of the phrases that are active in this step, in one shard."""

    def parts(lang: str, n: int, words: np.ndarray, acc: np.ndarray, since: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, first = _grouped(words, acc)
        c = np.diff(np.append(first, len(order)))
        at = order[first]
        words, since, c, bucket = words[at], since[at].astype(np.uint16), c.astype(np.int64), (acc[at] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))  # hashes rise, and buckets with them
        rows = [(lang, n, int(bucket[i]), words[i:j].tobytes(), since[i:j].tobytes(), c[i:j].tobytes(), False) for i, j in _runs(cuts, n)]
        yield from _batched(rows, _FOUND)

    def count(lang: str, h: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
        table = sieve.value
        mask = np.uint64(table.shape[1] - 1)
        at = np.flatnonzero(h)
        acc = np.zeros(len(h), np.uint64)
        acc[at] = mix(h[at] ^ _seed(lang))
        since = np.zeros(len(at), np.int32)
        if step < shards:
            yield from parts(lang, 1, h[at][:, None], acc[at], since)
        for n in range(2, most + 1):
            step_of = table[n - 2][(acc[at] & mask).astype(np.int64)].astype(np.int32)
            reach = np.zeros(len(h) + 1, np.int32)
            # a part whose slot another phrase wrote before it was seen itself counts from when it was seen
            reach[at] = np.where(step_of > 0, np.maximum(step_of, since), 0)
            at = np.flatnonzero((reach[:-1] > 0) & (reach[1:] > 0))
            since = np.maximum(reach[at], reach[at + 1])
            own = _longer(acc[at], h[at + n - 1])
            acc = np.zeros(len(h), np.uint64)
            acc[at] = own
            active = at[step < since + shards]
            if len(active):
                yield from parts(lang, n, np.stack([h[active + j] for j in range(n)], axis=1), acc[active], since[step < since + shards])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        # the longest phrases that can have become active within the last cycle; longer ones need no look
        latest = np.maximum.accumulate(sieve.value.max(axis=1))
        most = max([n for n in range(2, longest + 1) if sieve.value[n - 2].any() and latest[n - 2] > max(0, step - shards)], default=1)
        for b in slices(batches, 1):
            tokens = np.frombuffer(b["tokens"][0].as_buffer(), np.uint64)
            held.setdefault(b["lang"][0].as_py(), []).append(tokens.copy())
            size += len(tokens)
            if size >= HELD:
                for lang, arrays in held.items():
                    yield from count(lang, np.concatenate(arrays), most)
                held, size = {}, 0
        for lang, arrays in held.items():
            yield from count(lang, np.concatenate(arrays), most)

    return run


def _added(sieve, step: int, shards: int, longest: int, least: int):
    """One bucket's counts so far: those that go on, those whose cycle is over, and slots of phrases that have just reached ``least``."""

    def added(lang: str, n: int, bucket: int, table: pa.Table) -> list[tuple]:
        joined = lambda x, kind: np.concatenate([np.frombuffer(v.as_buffer(), kind) for v in table[x]])
        words, since, c = joined("words", np.uint64).reshape(-1, n), joined("since", np.uint16), joined("count", np.int64)
        old = c * np.repeat(np.array(table["old"].to_pylist()), [len(v.as_buffer()) // 8 for v in table["count"]])
        acc = mix(words[:, 0] ^ _seed(lang))
        for j in range(1, n):
            acc = _longer(acc, words[:, j])
        order, first = _grouped(words, acc)
        c, old, at = np.add.reduceat(c[order], first), np.add.reduceat(old[order], first), order[first]
        words, since, acc = words[at], since[at], acc[at]
        fresh = np.empty(0, np.int32)
        if n < longest:
            slot = (acc & np.uint64(sieve.value.shape[1] - 1)).astype(np.int64)
            fresh = np.unique(slot[(c >= least) & (old < least) & (sieve.value[n - 1][slot] == 0)])
        over = since.astype(np.int64) + shards - 1 <= step
        done = over & (c >= least)
        out = [(lang, n, bucket, b"", b"", b"", b"", b"", fresh.tolist())]
        w, x = words[done], c[done]
        out += [(lang, n, bucket, b"", b"", b"", w[i:j].tobytes(), x[i:j].tobytes(), []) for i, j in _runs(np.array([0, len(x)]), n)]
        w, t, x = words[~over], since[~over], c[~over]
        out += [(lang, n, bucket, w[i:j].tobytes(), t[i:j].tobytes(), x[i:j].tobytes(), b"", b"", []) for i, j in _runs(np.array([0, len(x)]), n)]
        return out

    def run(table: pa.Table) -> pa.Table:
        n, bucket, lang = table["n"][0].as_py(), table["bucket"][0].as_py(), table["lang"].combine_chunks().dictionary_encode()
        rows = [r for k, x in enumerate(lang.dictionary.to_pylist()) for r in added(x, n, bucket, table.filter(pc.equal(lang.indices, k)))]
        return pa.Table.from_batches(_batched(rows, _MERGED), _MERGED)

    return run


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per phrase; the words of a key have their highest byte first."""
    for b in slices(batches, 1):
        n, c = b["n"][0].as_py(), np.frombuffer(b["over_count"][0].as_buffer(), np.int64)
        keys = np.frombuffer(b["over_words"][0].as_buffer(), np.uint64).astype(">u8").reshape(-1, n)
        yield pa.RecordBatch.from_arrays([pa.repeat(b["lang"][0], len(c)), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array(c)], ["lang", "key", "f"])


def _spelt(tokens: DataFrame, scratch: Scratch, counts: DataFrame, salt: str) -> DataFrame:
    """The frequent words by hash, ``(w, word, other)``: two words where a hash is not of one word alone."""
    h = F.xxhash64(F.concat("word", F.lit(salt)))
    key = F.unhex(F.lpad(F.hex(F.when(h == 0, F.lit(1).cast("long")).otherwise(h)), F.lit(16), F.lit("0")))
    wanted = counts.filter(F.length("key") == 8).select(F.col("key").alias("w")).distinct()
    given = tokens.select(F.explode("words").alias("word")).select(key.alias("w"), "word").distinct().join(wanted, "w", "left_semi")
    return scratch.cut(given.groupBy("w").agg(F.min("word").alias("word"), F.max("word").alias("other")))


def frequent_phrases(docs: DataFrame, scratch: Scratch, least: int = 100, longest: int = 5, shards: int = 3, slots: int = 2**22, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases of up to ``longest`` words that occur ``least`` times or more in a language, with exact counts.

    Shards of the corpus are read one after the other, over and over. A word is counted from the
    start. A longer phrase becomes active in the step after both of its parts, all words but the
    last and all but the first, have been counted ``least`` times; so phrases of every length are
    counted in the same steps. Each is counted for exactly one cycle, in every shard once.

    Tasks learn what is active from a table of fixed size, ``slots`` entries for each length below the
    longest: the step in which a phrase of that hash reached ``least``. A step once written stays. So
    phrases that share a slot may be counted too early or in vain, but never in part: a phrase
    starts with the latest step among the slots of all phrases inside it, as it is not seen before
    that; this is the same for all tasks, and counts are exact however full the table.

    Counts travel as arrays, one for each language, length and range of hashes, so that a shuffle has
    few rows; a task adds each of its counts up before it sends them, so frequent phrases are no load.
    Arrays, batches and ranges are bounded whatever the size of the corpus and the share of active phrases.

    Returns ``(lang, key, f)``, the key being the hashes of the words (8 bytes each), ``(w, word)``
    and ``(lang, n)``, the words of each language in all.
    """
    with _settings(docs.sparkSession):
        return _frequent(docs, scratch, least, longest, shards, slots, lang_col, text_col)


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """Rows of hashed words are long: batches for tasks are bounded by bytes too, few rows of a table are read at once, and tables packed tighter."""
    wanted = {"spark.sql.execution.arrow.maxBytesPerBatch": "2097152", "spark.sql.parquet.columnarReaderBatchSize": "64", "spark.sql.parquet.compression.codec": "zstd"}
    before = {n: spark.conf.get(n, None) for n in wanted}
    for n, v in wanted.items():
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def _frequent(docs: DataFrame, scratch: Scratch, least: int, longest: int, shards: int, slots: int, lang_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    salt = ""
    while True:
        tokens = scratch.cut(rows.mapInArrow(_tokenised(shards, salt), "lang string, shard int, n long, tokens binary, words array<string>"))
        counts, totals = _cycles(tokens, scratch, least, longest, shards, slots)
        words = _spelt(tokens, scratch, counts, salt)
        scratch.drop(tokens)
        if words.filter("word <> other").isEmpty():
            return counts, words.drop("other"), totals
        scratch.drop(counts, totals, words)
        salt += "'"  # two words have one hash: hash them all anew


def _cycles(tokens: DataFrame, scratch: Scratch, least: int, longest: int, shards: int, slots: int) -> tuple[DataFrame, DataFrame]:
    """The steps over the shards of hashed words: ``(lang, key, f)`` and ``(lang, n)``."""
    spark = tokens.sparkSession
    totals = scratch.cut(tokens.groupBy("lang").agg(F.sum("n").alias("n")))
    held = totals.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    buckets = min(2**31, 1 + held // (shards * BUCKET))
    sieve = np.zeros((max(longest - 1, 1), slots), np.uint8 if longest * shards < 255 else np.uint16)
    state, done, step, last = None, [], 0, shards - 1
    while step <= last:
        sent = spark.sparkContext.broadcast(sieve)
        found = tokens.filter(F.col("shard") == step % shards).select("lang", "tokens").mapInArrow(_counted(sent, step, shards, longest, buckets), _PART_DDL + ", old boolean")
        if state is not None:
            found = found.unionByName(state.filter(F.length("words") > 0).select("lang", "n", "bucket", "words", "since", "count", F.lit(True).alias("old")))
        now = scratch.cut(found.groupBy("n", "bucket").applyInArrow(_added(sent, step, shards, longest, least), _PART_DDL + ", over_words binary, over_count binary, fresh array<int>"))
        sent.destroy()
        if state is not None:
            scratch.drop(state)
        # a map of bits for each 32768 slots: of a fixed size in all
        fresh = now.select("n", F.explode("fresh").alias("s")).withColumn("s", F.col("s") + 1).groupBy("n", F.bitmap_bucket_number("s").alias("b"))
        for r in fresh.agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")).collect():
            at = np.flatnonzero(np.unpackbits(np.frombuffer(r["m"], np.uint8), bitorder="little")) + (r["b"] - 1) * 32768
            sieve[r["n"] - 1][at] = step + 1
            last = max(last, step + shards)
        done.append(scratch.cut(now.filter(F.length("over_count") > 0).select("lang", "n", "over_words", "over_count").mapInArrow(_listed, "lang string, key binary, f long")))
        state, step = now, step + 1
    scratch.drop(state)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    counts = scratch.cut(out)
    scratch.drop(*done)
    return counts, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, shards: int = 3, slots: int = 2**22, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The phrases of each language whose words stand together most unexpectedly.

    Texts (null: empty), A-Z lowered, are split at ``. , ; : ! ?`` and line ends into pieces, and
    those at blanks into words. Candidates are the phrases of 2 to ``longest`` words that occur
    ``least`` times within pieces of a language (null: ``und``), overlaps included. A cut of a
    candidate into two parts scores ``floor(1000 * a * n / (l * r))`` from its own count, all words and
    the counts of the parts; the lowest cut counts (ties: the shorter first part). Candidates that
    stand inside a longer one as frequent are dropped. See :func:`frequent_phrases` for the counting.

    Returns up to ``top`` rows a language by score, count and phrase (bytes): ``lang, rank, phrase, a, l, r,
    n, score``. Repeated rows count each. An empty table, or one without frequent phrases, gives
    no row. Two words with the same 64-bit hash are noticed and hashed anew. A language of any share
    is ranked in 64 groups first.
    """
    scratch = Scratch(docs.sparkSession)
    counts, words, totals = frequent_phrases(docs, scratch, least, longest, shards, slots, lang_col, text_col)
    size = F.length("key") / 8
    long = counts.filter(size >= 2).select("lang", "key", F.col("f").alias("a"), size.cast("int").alias("m"))

    def part(start, count):
        return F.substring("key", start * 8 + 1, count * 8)

    k = F.col("k")
    cuts = long.select("*", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k")).select("*", part(F.lit(0), k).alias("left"), part(k, F.col("m") - k).alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("key").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(counts.select("lang", F.col("key").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    big = "decimal(38,0)"
    cuts = cuts.join(totals, "lang").withColumn("score", F.expr(f"cast(cast(a AS decimal(19,0)) * cast(n AS decimal(19,0)) AS {big}) * 1000BD div cast(cast(l AS decimal(19,0)) * cast(r AS decimal(19,0)) AS {big})"))
    scored = cuts.groupBy("lang", "key", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "key", "a", "n", "x.score", "x.l", "x.r")
    # what stands inside of longer ones
    runs = F.flatten(F.transform(F.sequence(F.lit(2), F.col("m") - 1), lambda c: F.transform(F.sequence(F.lit(0), F.col("m") - c), lambda s: F.substring(F.col("key"), s * 8 + 1, c * 8))))
    inside = long.filter("m > 2").select("lang", "a", F.explode(F.array_distinct(runs)).alias("key")).groupBy("lang", "key").agg(F.max("a").alias("longer"))
    kept = scratch.cut(scored.join(inside, ["lang", "key"], "left").filter("longer IS NULL OR longer < a").drop("longer"))
    spelt = kept.select("lang", "key", F.posexplode(F.transform(F.sequence(F.lit(0), (size - 1).cast("int")), lambda i: F.substring(F.col("key"), i * 8 + 1, 8))).alias("i", "w")).join(words, "w")
    spelt = spelt.groupBy("lang", "key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))  # at most ``longest`` words
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = Window.partitionBy("lang", F.pmod(F.xxhash64("key"), F.lit(64))).orderBy(*order)
    first = kept.join(spelt, ["lang", "key"]).withColumn("_g", F.row_number().over(group)).filter(F.col("_g") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
