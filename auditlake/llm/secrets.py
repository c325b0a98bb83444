"""Secret scan with corpus-wide ownership frequency, in built-in functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import Scratch

#: Kinds in the order in which ties of a start are listed.
KINDS = ("assign", "access", "hex", "token")
#: Patterns of the kinds. A match counts only if it also has the kind's least length.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "token": r"[A-Za-z0-9+/_-]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24, "token": 24}
#: What a text must hold to be looked at more closely; every match of a kind holds it.
GATE = {
    "assign": r"(?i:passw|secret|token|api_?key)",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "token": r"[A-Za-z0-9+/_-]{24}",
}
#: Matches of a text that are gathered at a time.
_PIECE = 128
_SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
#: Runs shorter than these never count, so the scans may step over them.
FAST = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}", "token": r"[A-Za-z0-9+/_-]{24,}"}


def _fold(rows: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Spans gathered along an array by ``step``, from ``(at, out)`` and an element to the next ``(at, out)``.

    This goes in pieces, as an array is copied whenever it grows.
    """
    none = F.array().cast(_SPANS)

    def whole(all_: Column) -> Column:
        pieces = F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_) - 1, F.lit(0)) / _PIECE).cast("int"))

        def piece(acc: Column, i: Column) -> Column:
            got = F.array(F.aggregate(F.slice(all_, i * _PIECE + 1, F.lit(_PIECE)), F.struct(acc["at"].alias("at"), none.alias("out")), step))
            return F.transform(got, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))[0]

        return F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out")), piece, lambda acc: F.flatten(acc["out"]))

    # a variable of a lambda is computed once, anything else for every piece
    return F.transform(F.array(rows), whole)[0]


def _clear(token: Column, base: Column) -> Column:
    """Tokens that overlap no base span, in order.

    Ends of tokens and starts of base spans are gone through together: a token is clear if no base
    span that starts before its end ends after its start. Tokens don't overlap each other.
    """
    event = lambda s, at, kind, value: F.struct(s[at].alias("at"), F.lit(kind).alias("base"), s["start"].alias("start"), s["end"].alias("end"), value.alias("value"))
    events = F.array_sort(F.concat(F.transform(token, lambda s: event(s, "end", 0, s["value"])), F.transform(base, lambda s: event(s, "start", 1, F.lit("")))))

    def step(acc: Column, x: Column) -> Column:
        span = F.struct(F.lit("token").alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"))
        clear = (x["base"] == 0) & (acc["at"] <= x["start"])
        return F.struct(F.when(x["base"] == 1, F.greatest(acc["at"], x["end"])).otherwise(acc["at"]).alias("at"), F.when(clear, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.when(F.size(base) == 0, token).otherwise(_fold(events, step))


def _found(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, value) of one kind, in code points, end exclusive.

    The gaps between matches (``split``) and the matches themselves give the positions: the
    i-th match starts after i+1 gaps and i matches.
    """
    pattern = FAST.get(kind, PATTERNS[kind])
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if kind == "assign" else hits
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), values.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.coalesce(x["gap"], F.lit(0))
        end = begin + F.length(x["hit"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        keep = F.length(x["value"]) >= LEAST[kind]
        return F.struct(F.coalesce(end, begin).alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    out = _fold(rows, step)
    if kind == "token":
        mixed = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9].*[0-9]")
        out = F.filter(out, lambda s: mixed(s["value"]))
    return F.when(text.rlike(GATE[kind]), out).otherwise(F.array().cast(_SPANS))


def _joined(spans: Column) -> Column:
    ordered = F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(ordered, ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), wide_owners: int = 3, wide_repos: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """Find secret candidates in whole texts and weigh each by who owns it across the corpus.

    Candidates are the three base kinds (``assign``, ``access``, ``hex``) and ``token``: other
    mixed-case runs of 24 or more characters with digits. Every candidate value is hashed, and
    the hashes are counted by distinct owners (``owner_col``) and repositories (``repo_cols``
    together). A hash of at least ``wide_owners`` owners or ``wide_repos`` repositories is a
    widely copied example; the others are owner-specific and look live. Base spans are always
    reported; a ``token`` span is added only if it is owner-specific.

    Returns one row per input row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``
    (kind:start:end in code points, end exclusive), ``n_live`` and ``n_example`` (candidates by
    verdict, a doc's repeats of a value counted each), ``live_spans`` (the spans of the live
    ones) and the columns named in ``carry``. A null text counts as empty. An empty table gives no row. A null owner or
    repository counts as one owner or repository of its own. Repeated rows are each reported.
    Other columns, whatever their names, are not read.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        *carry,
        F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit("")).alias("_owner"),
        F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(repo_cols)])).alias("_repo"),
        *[_found(text, k).alias(f"_{k}") for k in KINDS],
    )
    base = base.withColumn("_base", F.concat("_assign", "_access", "_hex"))
    # a token that overlaps a base span adds nothing
    hashed = F.transform(F.concat("_base", _clear(F.col("_token"), F.col("_base"))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.sha2(s["value"], 256).alias("hash")))
    scan = scratch.cut(
        base.select(
            "doc_id", *carry, "_owner", "_repo",
            *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:3]],
            F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
            hashed.alias("_spans"),
        )
    )
    some = scan.filter(F.size("_spans") > 0)
    seen = some.select("_owner", "_repo", F.explode(F.array_distinct(F.transform("_spans", lambda s: s["hash"]))).alias("hash")).groupBy("hash", "_owner", "_repo").agg(F.lit(1).alias("one"))
    wide = scratch.cut(
        seen.groupBy("hash", "_owner").agg(F.count("*").alias("repos"))
        .groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
        .filter((F.col("owners") >= wide_owners) | (F.col("repos") >= wide_repos)).select("hash", F.lit(True).alias("wide"))
    )
    # rows with the same candidates are judged once; the list of spans is the key that they share
    lists = scratch.cut(some.select(F.sha2(F.to_json("_spans"), 256).alias("_key"), "_spans").groupBy("_key").agg(F.first("_spans").alias("_spans")))
    each = lists.select("_key", F.explode("_spans").alias("s")).select("_key", "s", F.col("s.hash").alias("hash"))
    told = each.join(wide, "hash", "left").select("_key", F.struct(F.col("s.kind").alias("kind"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("wide").isNull().alias("live")).alias("s"))
    told = scratch.cut(told.groupBy("_key").agg(F.collect_list("s").alias("_told")))
    scratch.keep(scan, told)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,live:boolean>>")
    out = some.withColumn("_key", F.sha2(F.to_json("_spans"), 256)).join(told, "_key").drop("_key")
    out = out.unionByName(scan.filter(F.size("_spans") == 0).withColumn("_told", none))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        _joined(F.filter("_told", lambda s: (s["kind"] != "token") | s["live"])).alias("spans"),
        F.size(F.filter("_told", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("_told", lambda s: ~s["live"])).cast("long").alias("n_example"),
        _joined(F.filter("_told", lambda s: s["live"])).alias("live_spans"),
        *carry,
    )


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """``text`` with the spans (kind:start:end, comma-joined) replaced, overlapping ones as one."""
    rows = F.array_sort(F.transform(F.filter(F.split(spans, ","), lambda s: s != ""), lambda s: F.struct(F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("start"), F.split_part(s, F.lit(":"), F.lit(3)).cast("int").alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, piece).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(rows, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(rows) > 0, done).otherwise(text)
