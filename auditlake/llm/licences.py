"""Licence scan: one suffix automaton of all licence texts, matching statistics, chains of long matches."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch, slices
from auditlake.llm.licence_texts import PHRASES, TEMPLATES

#: Words that the licence texts may have in all: their automaton is sent to every task.
MOST_WORDS = 1_000_000
#: Letters in lower case, digits and what is not ASCII stay; all else parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SPAN = [("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("covered", pa.int32()), ("share", pa.float64())]
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct(_SPAN)))])
_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,template:int,first:long,last:long,covered:int,share:double>>"


def licence_words(text: str | None) -> list[bytes]:
    """Words of a text: runs of letters, digits and characters outside ASCII, A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Generalised suffix automaton of several texts: a path for every run of words of any of them."""

    def __init__(self, texts: Sequence[Sequence[bytes]], phrases: Mapping[tuple[bytes, ...], str]):
        self.words = {w: i for i, w in enumerate(dict.fromkeys(w for t in (*texts, *phrases) for w in t))}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]
        for number, text in enumerate((*texts, *phrases)):
            at = 0
            for place, w in enumerate(text):
                at = self._extend(at, self.words[w])
                if number < len(texts):
                    self.ends[at].append((number, place + 1))
        self.below: list[list[int]] = [[] for _ in self.next]
        for s, up in enumerate(self.link[1:], 1):
            self.below[up].append(s)
        # phrases that end wherever a state's strings end: (length, label)
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.next]
        for words, label in phrases.items():
            at = 0
            for w in words:
                at = self.next[at][self.words[w]]
            self.phrases[at].append((len(words), label))
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            self.phrases[s] += self.phrases[self.link[s]]
        self._places: dict[int, list[tuple[int, int]]] = {}

    def _new(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.length.append(length)
        self.link.append(link)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, at: int, w: int, old: int) -> int:
        """The state of the strings of ``old`` that are not longer than those of ``at`` and one word."""
        twin = self._new(self.length[at] + 1, self.link[old], dict(self.next[old]))
        self.link[old] = twin
        while at >= 0 and self.next[at].get(w) == old:
            self.next[at][w] = twin
            at = self.link[at]
        return twin

    def _extend(self, last: int, w: int) -> int:
        known = self.next[last].get(w)
        if known is not None:  # another text went here
            return known if self.length[known] == self.length[last] + 1 else self._split(last, w, known)
        new, at = self._new(self.length[last] + 1, 0, {}), last
        while at >= 0 and w not in self.next[at]:
            self.next[at][w] = new
            at = self.link[at]
        if at >= 0:
            old = self.next[at][w]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._split(at, w, old)
        return new

    def places(self, state: int) -> list[tuple[int, int]]:
        """``(text, end)`` of every place where the strings of a state end."""
        if state not in self._places:
            found, todo = [], [state]
            while todo:
                s = todo.pop()
                found += self.ends[s]
                todo += self.below[s]
            self._places[state] = found
        return self._places[state]

    def stream(self, words: Sequence[bytes], least: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, str]]]:
        """Matches that can't be continued, ``(end, length, state)``, and phrases, ``(start, label)``, of a text.

        The state after each word stands for the longest run that ends there and is in any of the
        automaton's texts: the matching statistics, in one pass.
        """
        nxt, link, lengths, phrases = self.next, self.link, self.length, self.phrases
        matches, named = [], []
        state = n = before = 0
        get = self.words.get
        for i, w in enumerate(map(get, words)):
            if w is None:
                if n >= least:
                    matches.append((i, n, state))
                state = n = 0
                continue
            before, came = n, state
            while state and w not in nxt[state]:
                state = link[state]
                n = lengths[state]
            if w in nxt[state]:
                state, n = nxt[state][w], n + 1
            else:
                state = n = 0
            if n <= before and before >= least:
                matches.append((i, before, came))
            for size, label in phrases[state]:
                if size <= n:
                    named.append((i + 1 - size, label))
        if n >= least:
            matches.append((len(words), n, state))
        return matches, named


def chains(anchors: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """``(first, last, covered)`` of chains of matches ``(end in the text, end in the template, length)``.

    Both orders rise along a chain and neither leaves out more than ``gap`` words at a time; words
    that two matches share count once. Each match joins the chain that covers most so far; the
    largest chains are taken first, and a match is in one only.
    """
    anchors = sorted(anchors)
    best: list[int] = []
    back: list[int] = []
    for j, (end, at, n) in enumerate(anchors):
        best.append(n)
        back.append(-1)
        for p in range(j - 1, -1, -1):
            e, a, _ = anchors[p]
            if end - n - e > gap:
                break
            new = min(n, end - e, at - a)
            if new > 0 and at - n - a <= gap and best[p] + new > best[j]:
                best[j], back[j] = best[p] + new, p
    used, out = set(), []
    for j in sorted(range(len(anchors)), key=lambda j: (-best[j], anchors[j])):
        if j in used:
            continue
        first = covered = None
        p = j
        while p >= 0 and p not in used:
            used.add(p)
            first = anchors[p][0] - anchors[p][2]
            covered = best[j] - best[p] + anchors[p][2]
            p = back[p]
        out.append((first, anchors[j][0], covered))
    return out


@lru_cache(maxsize=4)
def _automaton(texts: tuple, phrases: tuple) -> Automaton:
    return Automaton(texts, dict(phrases))


def _scanner(labels: tuple[str, ...], texts: tuple, phrases: tuple, least: int, gap: int, share: float):
    def spans(auto: Automaton, matches: list[tuple[int, int, int]]) -> list[dict]:
        by = defaultdict(list)
        for end, n, state in matches:
            for number, at in auto.places(state):
                by[number].append((end, at, n))
        out = []
        for number, anchors in by.items():
            size = len(texts[number])
            if sum(n for _, _, n in anchors) < share * size:
                continue  # all matches together cover too little
            for first, last, covered in chains(anchors, gap):
                if covered >= share * size:
                    out.append({"label": labels[number], "template": number, "first": first, "last": last, "covered": covered, "share": covered / size})
        return sorted(out, key=lambda s: (s["first"], s["template"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _automaton(texts, phrases)
        for b in slices(batches, 200):
            out = []
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
                words = licence_words(text)
                matches, named = auto.stream(words, least)
                found = spans(auto, matches)
                base = {label for _, label in named}
                starts = [s for s, _ in named]
                out.append((doc, len(words), len(named), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s["label"] for s in found})), 1.0 if base else max((s["share"] for s in found), default=0.0), found))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return run


def licence_scan(
    docs: DataFrame, templates: Mapping[str, Sequence[str]] | None = None, phrases: Mapping[str, str] | None = None, least: int = 3, gap: int = 32, share: float = 0.75, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Licences that whole texts carry: short phrases, and spans that cover most of a licence text or notice.

    All ``templates`` (texts by label, together at most ``MOST_WORDS`` words, else ``ValueError``) and
    ``phrases`` (labels by phrase) go into one generalised suffix automaton, which every task builds
    once. Words of a text stream through it and leave the longest match that ends at each word.
    Matches of ``least`` words or more are chained along each template, leaving out up to ``gap``
    words at a time; a chain that covers the given ``share`` of a template's words is a span.

    Returns a row per row: ``doc_id, n_words, n_base`` (places of phrases), ``first_word, last_word``
    (their smallest and largest start, null without any), ``base_labels, labels`` (of phrases; of
    phrases and spans), ``score`` (1 with a phrase, else the largest share of a span, else 0) and
    ``spans`` (label, number of the template, first word, word after the last, words covered,
    share). Null and empty texts have no words. Repeated rows count each, null ids stay null. Equal
    spans of two templates are both given. An empty table gives no row. Nothing is shuffled.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    pairs = [(label, tuple(licence_words(t))) for label, texts in templates.items() for t in texts]
    named = tuple((tuple(licence_words(p)), label) for p, label in phrases.items())
    if sum(len(t) for _, t in pairs) + sum(len(p) for p, _ in named) > MOST_WORDS:
        raise ValueError(f"the licence texts have more than {MOST_WORDS} words")
    Scratch(docs.sparkSession)  # gives tasks this package, and batches of bounded size
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scanner(tuple(x for x, _ in pairs), tuple(t for _, t in pairs), named, least, gap, share), _OUT)
