"""Record filters as boolean columns, whole-transaction retention, and checks of patterns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.text import any_of
from auditlake.functions.words import FEW, contains_any
from auditlake.schema import META_FIELDS

#: Exact sets longer than this are joined instead of listed.
LISTED = 1000
#: A pattern without signs that mean something: it is found where its text is.
_PLAIN = re.compile(r"[^\\^$.|?*+()\[\]{}]+")


def _search(name: str, patterns: Iterable[str]) -> Column:
    """Any pattern is found; where there are many, those that are plain text are looked for at once."""
    patterns = [*patterns]
    plain = [p for p in patterns if _PLAIN.fullmatch(p)]
    if len(plain) <= FEW:
        plain = []
    found = any_of([F.col(name).rlike("(?U)" + p) for p in patterns if not plain or not _PLAIN.fullmatch(p)])
    return found | contains_any(F.col(name), plain) if plain else found


def time_range(start: str | None = None, end: str | None = None) -> Column:
    """Times are compared as text; an end such as ``2025-01-15`` takes the whole day in."""
    ts, keep = F.col("ts"), F.lit(True)
    if start:
        keep &= (ts >= start) | ts.startswith(start)
    if end:
        keep &= (ts <= end) | ts.startswith(end)
    return keep


def include(patterns: Mapping[str, Iterable[str]]) -> Column:
    """Any pattern of a field must be found, for every field that has some."""
    return reduce(lambda a, b: a & b, [_search(f, p) for f, p in patterns.items() if p], F.lit(True))


def exclude(patterns: Mapping[str, Iterable[str]]) -> Column:
    """A record goes if any pattern of any field is found."""
    return ~any_of([_search(f, p) for f, p in patterns.items() if p])


def trx_in(ids: Iterable[str]) -> Column:
    """Exact transaction ids."""
    return F.col("trx_id").isin([*ids])


def tags(wanted: Iterable[str] = (), unwanted: Iterable[str] = ()) -> Column:
    """Wanted tags drop untagged records, unwanted ones keep them."""
    keep = F.lit(True)
    if wanted := [*wanted]:
        keep &= _search("tag", wanted)
    if unwanted := [*unwanted]:
        keep &= ~_search("tag", unwanted)
    return keep


def record_sql(wanted: Iterable[str] = (), unwanted: Iterable[str] = ()) -> Column:
    """Patterns on the statement of tagged records; untagged ones always pass."""
    wanted, unwanted = [*wanted], [*unwanted]
    found = _search("sql", wanted) if wanted else F.lit(True)
    return F.col("tag").isNull() | (found & ~_search("sql", unwanted))


def stats_any(words: Mapping[str, Iterable[str]], trx_ids: Iterable[str] = (), start: str | None = None, end: str | None = None) -> Column:
    """The filter of statistics: a time range, and any plain text of any field or an exact transaction id."""
    tests = [contains_any(F.col(f), ws) for f, ws in ((f, [*ws]) for f, ws in words.items()) if ws]
    if ids := [*trx_ids]:
        tests.append(trx_in(ids))
    return time_range(start, end) & (any_of(tests) if tests else F.lit(True))


def indicators(exec_ids: Iterable[int] = (), min_ms: float | None = None, min_rows: int | None = None) -> Column:
    """Execution id in the set, or slow, or many rows; false if nothing is asked."""
    tests = []
    if ids := [*exec_ids]:
        tests.append(F.col("exec_id").isin(ids))
    if min_ms is not None:
        tests.append(F.col("exec_time_ms") >= min_ms)
    if min_rows is not None:
        tests.append(F.col("row_count") >= min_rows)
    return any_of(tests)


def txn_sql(wanted: Iterable[str] = (), unwanted: Iterable[str] = ()) -> Column:
    """Plain texts in the statement: any wanted one and no unwanted one."""
    wanted = [*wanted]
    found = contains_any(F.col("sql"), wanted) if wanted else F.lit(True)
    return found & ~contains_any(F.col("sql"), unwanted)


def retain_transactions(records: DataFrame, matched: Column, explicit: Iterable[str] = ()) -> DataFrame:
    """All records of the transactions in which some record matches, or whose id is given.

    Ids are distinct before the shuffle; Spark broadcasts them where they are small.
    """
    ids = records.filter(matched).select("trx_id")
    if explicit := [*explicit]:
        ids = ids.unionByName(records.sparkSession.createDataFrame([(x,) for x in explicit], "trx_id string"))
    return records.join(ids.distinct(), "trx_id", "left_semi").select(*records.columns)


def by_trx_ids(records: DataFrame, ids: Iterable[str]) -> DataFrame:
    """Records of the given transactions; long lists become a semi join."""
    ids = [*ids]
    return records.filter(trx_in(ids)) if len(ids) <= LISTED else retain_transactions(records, F.lit(False), ids)


def pipeline(records: DataFrame, steps: Iterable[Column | Callable[[DataFrame], Column]], enabled: bool = True) -> DataFrame:
    """Keep the records that pass every step, in order; no steps, or not enabled, keeps all.

    A step is a boolean column, or a function that makes one from the records.
    """
    if not enabled:
        return records
    tests = [s(records) if callable(s) and not isinstance(s, Column) else s for s in steps]
    return records.filter(reduce(lambda a, b: a & b, tests)) if tests else records


def check_patterns(spark: SparkSession, *filters: Mapping[str, Iterable[str]]) -> None:
    """Raise ``ValueError`` naming the field of an unknown field or a pattern that is no regular expression.

    Takes the patterns of any number of filters; the JVM that runs them compiles them, without a job.
    """
    compiled = spark._jvm.java.util.regex.Pattern
    for name, p in ((name, p) for patterns in filters for name, ps in patterns.items() for p in (None, *ps)):
        if name not in (*META_FIELDS, "tag", "sql"):
            raise ValueError(f"{name}: no such field")
        try:
            if p is not None:
                compiled.compile("(?U)" + p)
        except Exception as e:
            raise ValueError(f"{name}: {p!r} is no regular expression") from e
