"""Language identification in two steps: the family first, then pairs of languages within it."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditlake.llm.common import ship, slices

#: Languages by family. A language that is not listed is a family of its own, so the first step alone tells it.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
UNKNOWN = "und"


def features(texts: list[str | None], width: int = 4096) -> np.ndarray:
    """Square roots of hashed byte n-gram counts (1 to 3 bytes, lower case) of whole texts, each row of length 1."""
    out = np.zeros((len(texts), width), np.float32)
    shift = np.uint32(32 - (width.bit_length() - 1))
    for i, t in enumerate(texts):
        if not t:
            continue
        b = np.frombuffer(t.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(257) + b[1:] + np.uint32(1 << 16)
        three = b[:-2] * np.uint32(66049) + b[1:-1] * np.uint32(257) + b[2:] + np.uint32(1 << 24)
        codes = (np.concatenate([b, two, three]) * np.uint32(2654435761)) >> shift
        out[i] = np.sqrt(np.bincount(codes, minlength=width))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, steps: int = 60) -> np.ndarray:
    """Weights (the last one is the bias) of a linear support vector machine with squared hinge loss.

    ``y`` holds -1 and 1. Accelerated gradient steps; rows of ``x`` have length 1, which bounds the
    curvature, and classes are weighed to count the same.
    """
    n = len(y)
    x = np.hstack([x, np.ones((n, 1), np.float32)])
    share = np.where(y > 0, n / (2 * max((y > 0).sum(), 1)), n / (2 * max((y < 0).sum(), 1))).astype(np.float32) / n
    w = v = np.zeros(x.shape[1], np.float32)
    step = np.float32(1 / (1 / c + 4 * share.max() * n))
    for k in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v / c - 2 * (x.T @ (share * y * slack)))
        w, v = new, new + np.float32(k / (k + 3)) * (new - w)
    return w


def sharpness(margins: np.ndarray, y: np.ndarray) -> float:
    """Slope ``a`` for which ``1 / (1 + exp(-a * margin))`` fits the labels best, between 0.5 and 20."""
    grid = np.geomspace(0.5, 20, 30)
    return float(grid[np.argmin([np.log1p(np.exp(-a * y * margins)).mean() for a in grid])])


class Model:
    """A one-against-the-rest machine per family, and a machine per pair of languages within a family."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]]):
        of = {lang: name for name, members in families.items() for lang in members}
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(of.get(lang, lang), []).append(lang)
        lang, group = np.array(langs, object), np.array([of.get(i, i) for i in langs], object)
        self.names = sorted(self.families)
        self.first = [self._fit(x, np.where(group == name, 1, -1)) for name in self.names] if len(self.names) > 1 else []
        self.pairs = {}
        for members in self.families.values():
            for p, q in combinations(members, 2):
                rows = np.flatnonzero((lang == p) | (lang == q))
                self.pairs[p, q] = self._fit(x[rows], np.where(lang[rows] == p, 1, -1))

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        y = y.astype(np.float32)
        w = linear_svm(x, y)
        return w, sharpness(x @ w[:-1] + w[-1], y)

    @staticmethod
    def _chance(x: np.ndarray, fit: tuple[np.ndarray, float]) -> np.ndarray:
        w, a = fit
        return 1 / (1 + np.exp(-a * (x @ w[:-1] + w[-1]).astype(np.float64)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        x = features(texts)
        if self.first:
            p = np.stack([self._chance(x, f) for f in self.first])
            family, sure = p.argmax(0), p.max(0) / np.maximum(p.sum(0), 1e-12)
        else:
            family, sure = np.zeros(len(x), int), np.ones(len(x))
        pair = {k: self._chance(x, f) for k, f in self.pairs.items()}
        out, score = [], []
        for i, t in enumerate(texts):
            if not self.names or not t or not any(map(str.isalpha, t)):
                out.append(UNKNOWN)
                score.append(0.0)
                continue
            members = self.families[self.names[family[i]]]
            wins = {m: [] for m in members}
            for p, q in combinations(members, 2):
                wins[p].append(pair[p, q][i])
                wins[q].append(1 - pair[p, q][i])
            best = max(members, key=lambda m: (sum(c > 0.5 for c in wins[m]), sum(wins[m])))
            out.append(best)
            score.append(float(sure[i] * (np.mean(wins[best]) if wins[best] else 1)))
        return out, score


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 500):
        x = features(b["text"].to_pylist()).astype(np.float16)
        yield pa.RecordBatch.from_pydict({"lang": b["lang"], "x": pa.array([r.tobytes() for r in x], pa.binary())})


def train(labelled: DataFrame, per_language: int = 800, families: dict[str, tuple[str, ...]] = FAMILIES, labels: int = 100, rows: int = 20_000) -> Model:
    """Fit a model on ``labelled(id, text, lang)``.

    The sample is bounded: the ``labels`` most frequent languages (ties: first by name) are learned,
    and of each about ``per_language`` rows, or an equal share of ``rows`` if that is less, picked by the
    hash of the id, give their whole texts. So however many labels a column has, the driver gets about
    ``rows`` lists of 4096 weights at most. Rows with a null text, language or id are not learned from.
    """
    spark = labelled.sparkSession
    ship(spark)
    own = labelled.filter("id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL")
    sizes = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(labels).collect()
    most = min(per_language, rows // max(len(sizes), 1))
    # a row for each of at most ``labels`` languages: texts stay where they are
    rates = F.broadcast(spark.createDataFrame([(r["lang"], most / r["n"]) for r in sizes], "lang string, rate double"))
    pick = F.pmod(F.xxhash64("id"), F.lit(1 << 53)) / F.lit(float(1 << 53)) < F.col("rate")
    got = own.join(rates, "lang").filter(pick).select("lang", "text").mapInArrow(_sampled, "lang string, x binary").collect()
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32) if got else np.zeros((0, 4096), np.float32)
    return Model(x, [r["lang"] for r in got], families)


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """``docs`` columns ``keep`` with ``lang_pred`` and ``score``; only the text is looked at."""
    ship(docs.sparkSession)
    text = docs.select(*keep, F.col(text_col).alias("_text_"))
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 500):
            lang, score = model.predict(b["_text_"].to_pylist())
            yield pa.RecordBatch.from_pydict({n: b[n] for n in names} | {"lang_pred": lang, "score": pa.array(score, pa.float64())})

    out = StructType([docs.schema[c] for c in keep]).add("lang_pred", "string").add("score", "double")
    return text.mapInArrow(run, out)


def held_out(id_col: str, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id's text falls in the part that is not learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 800) -> DataFrame:
    """Predict the language of every whole text, learning from the rows that are not held out.

    Returns a row per input row: ``doc_id, held_out, lang_pred, score``. The prediction is one of
    the languages learned, or ``und`` with score 0 for a text that is null or holds no letter, or
    if there was nothing to learn from. The score is the family's share among all families times
    the mean chance of the winner in its pairs; languages that tie go to the first by name. Repeated rows are each reported; a null id is
    never held out and never learned from. Other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(base.filter(~held_out("doc_id")).select(F.col("doc_id").alias("id"), "text", "lang"), per_language)
    return identify(base, model, ("doc_id",)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
