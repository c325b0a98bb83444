"""Many plain texts looked for at once: one automaton, one pass over each text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from auditlake.functions.text import any_of

#: Up to so many words are looked for one by one, inside generated code.
FEW = 16
#: Characters of all words together; the automaton of each task is some fifty times as large in bytes.
MOST = 8_000_000


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """Whether a text holds any of the words; false for a null text and for no words.

    A few words are tested one after the other. More of them make an Aho-Corasick automaton: the
    plan holds one function however many words there are, each task builds the automaton once, and
    a text is read once, to its first hit. Words are a list that is handed over, not a table: beyond
    ``MOST`` characters it is an error. The empty word is in every text.
    """
    words = sorted({*words})
    if "" in words:
        return text.isNotNull()
    if len(words) <= FEW:
        return any_of([text.contains(w) for w in words])
    if (size := sum(map(len, words))) > MOST:
        raise ValueError(f"words of {size} characters, {MOST} at most: join with a table of them instead")
    return F.coalesce(_automaton(words)(text), F.lit(False))


def _automaton(words: list[str]):
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, True)
        automaton.make_automaton()
        for texts in batches:
            yield pa.array([None if t is None else next(automaton.iter(t), None) is not None for t in texts.to_pylist()], pa.bool_())

    return F.arrow_udf(found, "boolean")
