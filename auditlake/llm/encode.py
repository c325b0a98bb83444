"""Token ids of whole texts by a public tokenizer file, with a bounded memory of pieces seen."""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Pieces whose ids a Python worker remembers at most; beyond it the memory starts anew.
PIECE_CACHE = 1_000_000
#: A single space between two other characters. A byte-level pre-tokenizer never joins what such
#: a space separates, and always starts a new piece with it.
_GAP = re.compile(r" (?<=\S )(?=\S)")
#: Where none of these occurs, every single space is such a gap.
_RUNS = tuple(x for w in " \n\t\r\x0b\x0c" for x in (w + " ", " " + w))
_OTHER = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_open: dict[str, Encoder] = {}


class Encoder:
    """``encode(texts)`` gives the ids that the tokenizers library gives, special tokens not added.

    For byte-level files each blank-separated piece is encoded once and remembered, which is
    several times faster than encoding every text in full; other files take the plain way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None
        self.by_piece = plain and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in spec.get("added_tokens", ()))
        size = self.tokenizer.get_vocab_size()
        self.leads = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.known: dict[str, bytes] = {}
        #: Narrowest unsigned integers that hold every id.
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, pieces: list[str]) -> None:
        known, simple, odd = self.known, [], []
        for p in pieces:
            (odd if " " in p or p[:1].isspace() or p[-1:].isspace() else simple).append(p)
        groups = [simple[i : i + 500] for i in range(0, len(simple), 500)]
        width = self.dtype.itemsize
        for some, got in zip(groups, self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(got.ids, self.dtype)
            at = (np.flatnonzero(self.leads[ids]) * width).tolist()
            if len(at) != len(some):  # a piece that isn't what it seems: one by one
                odd += some
                continue
            raw = ids.tobytes()
            for p, begin, end in zip(some, at, [*at[1:], len(raw)], strict=True):
                known[p] = raw[begin:end]
        for p in odd:
            known[p] = self._plain(" " + p)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.by_piece:
            return [np.frombuffer(self._plain(t or ""), self.dtype) for t in texts]
        split = [[""] if not t else (_GAP.split(t) if any(x in t for x in _RUNS) or _OTHER.search(t) else t.split(" ")) for t in texts]
        return self._joined(texts, split)

    def _joined(self, texts: list[str | None], split: list[list[str]]) -> list[np.ndarray]:
        needed = {x for p in split for x in p[1:]}
        if len(needed) > PIECE_CACHE:  # more than the memory holds: fewer texts at once, or one text in full
            if len(texts) == 1:
                return [np.frombuffer(self._plain(texts[0]), self.dtype)]
            half = len(texts) // 2
            return self._joined(texts[:half], split[:half]) + self._joined(texts[half:], split[half:])
        missing = [x for x in needed if x not in self.known]
        if len(self.known) + len(missing) > PIECE_CACHE:
            self.known.clear()
            missing = list(needed)
        if missing:
            self._learn(missing)
        known = self.known.__getitem__
        return [np.frombuffer(self._plain(p[0]) + b"".join(map(known, p[1:])), self.dtype) for p in split]


def encoder(path: str) -> Encoder:
    """The encoder of a file, one per Python worker."""
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]
