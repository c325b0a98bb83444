"""Column functions on SQL text: fingerprint, template, parameter lists and placeholders, labels."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string literal: doubled quotes stay inside, and an open one runs to the end.
LITERAL = r"'(?:[^']++|'')*+(?:'|\z)"
#: Words that a template writes in capitals.
KEYWORDS = (
    "SELECT", "FROM", "WHERE", "AND", "OR", "JOIN", "ON", "AS", "INSERT", "UPDATE", "DELETE", "INTO",
    "VALUES", "SET", "GROUP", "ORDER", "BY", "HAVING", "UNION", "DISTINCT", "LIMIT", "CREATE", "DROP", "ALTER",
    "IN", "NOT", "NULL", "IS", "BETWEEN", "LIKE", "EXISTS", "CASE", "WHEN", "THEN", "ELSE", "END",
)


def fingerprint(sql: Column) -> Column:
    """Literals and free-standing numbers as ``?``, runs of blanks as one space, ends trimmed."""
    out = F.regexp_replace(sql, LITERAL, "?")
    out = F.regexp_replace(out, r"(?<![A-Za-z0-9_.])[0-9][0-9.]*", "?")
    return F.trim(F.regexp_replace(out, r"[ \t\n\r\f]+", " "))


#: What begins a list after IN, what makes a sub-query, and comments of blocks.
_OPENS = r"(?i:IN)[ \t\n\r\f]*+\("
_QUERY = r"(?i:SELECT|FROM)(?![A-Za-z0-9_.])"
_COMMENT = r"/\*(?s:.*?)(?:\*/|\z)"
#: Those and brackets one by one, and all else, literals and comments included, in runs as long as they go.
_PIECES = rf"{_OPENS}|{_QUERY}|[()]|(?:{LITERAL}|{_COMMENT}|(?!{_OPENS}|{_QUERY})[A-Za-z0-9_.]++|[^'()/A-Za-z0-9_.]|/(?!\*))++"
_TOKENS = rf"{LITERAL}|(?:[ \t\n\r\f]|{_COMMENT})++|[A-Za-z0-9_.]++|(?s:.)"
#: Stands for a folded list; no text has this character.
_FOLDED = "\ufdd0"


def _lists(pieces: Column) -> Column:
    """First and last piece of each list after IN that holds no sub-query; none lies in another.

    One pass: a counter has the depth, a stack the lists that are open. A sub-query empties the
    stack, since every list around it stays as it is.
    """
    spans, marks = "array<struct<a: int, b: int>>", "array<struct<at: int, depth: int>>"
    begin = F.struct(F.lit(0).alias("i"), F.lit(0).alias("depth"), F.array().cast(marks).alias("open"), F.array().cast(spans).alias("lists"))

    def step(s: Column, piece: Column) -> Column:
        i, depth, last = s["i"] + 1, s["depth"], F.try_element_at(s["open"], F.lit(-1))
        listed, closes = piece.rlike(rf"\A{_OPENS}\z"), (piece == ")") & (depth > 0)
        ends = closes & (F.coalesce(last["depth"], F.lit(0)) == depth)
        deeper = F.when(listed | (piece == "("), 1).when(closes, -1).otherwise(0)
        pushed = F.array_append(s["open"], F.struct(i.alias("at"), (depth + 1).alias("depth")))
        open_ = F.when(listed, pushed).when(ends, F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1)).when(piece.rlike(rf"\A{_QUERY}\z"), F.array().cast(marks)).otherwise(s["open"])
        before = F.coalesce(F.try_element_at(s["lists"], F.lit(-1))["a"] < last["at"], F.lit(True))  # no list within this one
        outer = F.when(before, s["lists"]).otherwise(F.filter(s["lists"], lambda x: x["a"] < last["at"]))
        lists = F.when(ends, F.array_append(outer, F.struct(last["at"].alias("a"), i.alias("b")))).otherwise(s["lists"])
        return F.struct(i.alias("i"), (depth + deeper).alias("depth"), open_.alias("open"), lists.alias("lists"))

    return F.aggregate(pieces, begin, step, lambda s: s["lists"])


def _given(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _fold(sql: Column) -> Column:
    """The statement with a mark in place of each list after IN that holds no sub-query."""

    def joined(pieces: Column, lists: Column) -> Column:
        def between(k: Column) -> Column:
            start = F.when(k == 0, F.lit(1)).otherwise(F.try_element_at(lists, k)["b"] + 1)
            stop = F.coalesce(F.try_element_at(lists, k + 1)["a"], F.size(pieces) + 1)
            return F.array_join(F.slice(pieces, start, stop - start), "")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(lists)), between), _FOLDED)

    pieces = F.regexp_extract_all(F.replace(sql, F.lit(_FOLDED), F.lit("\ufffd")), F.lit(_PIECES), F.lit(0))
    folded = _given(pieces, lambda p: _given(_lists(p), lambda x: joined(p, x)))
    return F.when(sql.rlike(rf"(?<![A-Za-z0-9_.]){_OPENS}"), folded).otherwise(sql)


def template(sql: Column) -> Column:
    """The shape of a statement with its literals: comments go, keywords in capitals, IN lists folded.

    Line comments go with their line end; block comments and blanks become one space; a list after
    IN becomes ``IN (?)`` unless it holds a sub-query, however deep its brackets are nested; brackets
    in literals and comments do not count. Literals elsewhere stay as they are.
    """
    bare = F.regexp_replace(sql, rf"({LITERAL}|/\*(?s:.*?)(?:\*/|\z))|--[^\n]*(?:\n|\z)", "$1")
    tokens = F.regexp_extract_all(_fold(bare), F.lit(_TOKENS), F.lit(0))

    def shaped(t: Column) -> Column:
        first = F.substring(t, 1, 1)
        blank = first.isin(" ", "\t", "\n", "\r", "\f") | t.startswith("/*")
        word = F.upper(t)
        return F.when(blank, " ").when(first == "'", t).when(t == _FOLDED, "IN (?)").when(word.isin(*KEYWORDS), word).otherwise(t)

    return F.trim(F.array_join(F.transform(tokens, shaped), ""))


_ENTRY = r"\(\s*[^,]*,[^,]*,\s*('(?:[^']++|'')*+'\s*|[^')]*+)\)"
_LIST = rf"(?s)\A.*?=\{{\s*(?:{_ENTRY}\s*,?\s*)*+\}}\s*\z"


def params(body: Column) -> Column:
    """Values of a parameter record as SQL text, null for a body that is malformed.

    Quoted values keep their quotes; a missing value is ``NULL``.
    """
    inner = F.regexp_extract(body, r"(?s)=\{(.*)\}\s*\z", 1)
    values = F.transform(F.regexp_extract_all(inner, F.lit(_ENTRY), F.lit(1)), lambda v: F.trim(v))
    return F.when(body.rlike(_LIST), F.transform(values, lambda v: F.when(v == "", "NULL").otherwise(v)))


def _number(digits: Column) -> Column:
    """An ordinal; one beyond 64 bits counts as the largest number."""
    return F.coalesce(digits.try_cast("long"), F.lit(2**63 - 1))


def placeholders(sql: Column) -> Column:
    """``struct(n, ordinal)``: how many values a statement takes, and whether it names them ``:N``.

    Text inside literals does not count. The highest ``:N`` counts if there is any, else the ``?``.
    """
    bare = F.regexp_replace(sql, LITERAL, "")
    named = F.transform(F.regexp_extract_all(bare, F.lit(r":(\d++)"), F.lit(1)), _number)
    top = F.coalesce(F.array_max(named), F.lit(0).cast("long"))
    return F.struct(F.when(top > 0, top).otherwise(F.regexp_count(bare, F.lit(r"\?")).cast("long")).alias("n"), (top > 0).alias("ordinal"))


def bind(sql: Column, values: Column, ordinal: Column) -> Column:
    """The statement with its placeholders replaced, in sequence or by number; unmatched ones stay."""
    tokens = F.regexp_extract_all(sql, F.lit(rf"{LITERAL}|:\d++|\?|[^':?]++|(?s:.)"), F.lit(0))
    numbered = F.array_join(
        F.transform(tokens, lambda t: F.when(t.rlike(r"\A:\d+\z"), F.coalesce(F.try_element_at(values, F.greatest(F.lit(1), F.least(F.lit(2**31 - 1), _number(F.regexp_extract(t, r"\d+", 0)))).cast("int")), t)).otherwise(t)), ""
    )
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(acc: Column, t: Column) -> Column:
        hit = t == "?"
        return F.struct(F.concat(acc["out"], F.when(hit, F.coalesce(F.try_element_at(values, acc["n"] + 1), t)).otherwise(t)).alias("out"), (acc["n"] + hit.cast("int")).alias("n"))

    return F.when(ordinal, numbered).otherwise(F.aggregate(tokens, begin, step, lambda acc: acc["out"]))


def snippet(sql: Column, size: int = 120) -> Column:
    """The first characters of a statement, for reports."""
    return F.substring(sql, 1, size)


def label(text: Column, size: int = 40) -> Column:
    """Text of at most ``size`` characters, an ellipsis last where it was cut."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 1), F.lit("…"))).otherwise(text)


def safe_key(text: Column) -> Column:
    """A key fit for a file name: other characters as ``_``, 80 at most."""
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9_-]", "_"), 1, 80)


def strip_mapped_ip(ip: Column) -> Column:
    """An address without the prefix of a mapped one, if something follows it."""
    return F.regexp_replace(ip, r"\A(?i:::ffff:)(?=[\s\S])", "")


def whole_ms(ms: Column) -> Column:
    """Milliseconds as a long: cut towards zero, clamped, 0 where not finite."""
    top = 2.0**63
    return F.when(ms.isNull(), None).when(F.isnan(ms) | (F.abs(ms) == float("inf")), F.lit(0).cast("long")).when(ms >= top, F.lit(2**63 - 1)).when(ms <= -top, F.lit(-(2**63))).otherwise(ms.cast("long"))


def micros(ms: Column) -> Column:
    """Milliseconds as whole microseconds between 1 and a minute; what is not positive or finite counts as 1."""
    bad = ms.isNull() | F.isnan(ms) | (F.abs(ms) == float("inf")) | (ms <= 0)
    return F.when(bad, F.lit(1)).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(60_000_000.0), F.floor(ms * 1000)))).cast("long")


def bucket_low(us: Column) -> Column:
    """Lowest value of the two-digit histogram bucket: 256 unit buckets, then widths that double."""
    shift = F.greatest(F.lit(0), F.floor(F.log2(us.cast("double"))).cast("int") - 7)
    return F.call_function("shiftleft", F.call_function("shiftright", us, shift), shift)


def bucket_high(us: Column) -> Column:
    """Highest value of the histogram bucket."""
    shift = F.greatest(F.lit(0), F.floor(F.log2(us.cast("double"))).cast("int") - 7)
    return bucket_low(us) + F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1


def any_of(tests: list[Column]) -> Column:
    """Whether any test holds; false for no tests, and where all are null."""
    return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))
