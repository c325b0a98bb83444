"""Column functions on text, case by case."""

import random

import pytest
from pyspark.sql import functions as F

from auditlake.functions import text as X
from auditlake.functions.words import contains_any


def values(spark, f, cases):
    rows = [(i, *(c if isinstance(c, tuple) else (c,))) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, ["i"] + [f"c{j}" for j in range(len(rows[0]) - 1)])
    cols = [F.col(f"c{j}") for j in range(len(rows[0]) - 1)]
    return [r[0] for r in df.orderBy("i").select(f(*cols)).collect()]


def test_fingerprint(spark):
    cases = {
        "city <> 'Oslo' or zip=0150": "city <> ? or zip=?", "ratio between .5 and 17.25.3": "ratio between .5 and ?", "lim = 8e3": "lim = ?e3", "k9 = 9k": "k9 = ?k",
        "call  p ( 'don''t' ,\t'' )": "call p ( ? , ? )", "update a\nset b=-12,c='7'": "update a set b=-?,c=?", "f('x)": "f(?", "": "", " \t\r\nx\f1 ": "x ?", "s.3 q_4 5": "s.3 q_4 ?", "x\x0b1": "x\x0b?",
    }
    assert values(spark, X.fingerprint, [*cases]) == [*cases.values()]


def test_fingerprint_of_made_up_statements(spark):
    rng = random.Random(3)
    cases = {}
    for _ in range(200):
        parts = [(rng.choice(["'it''s'", "'a b'", "''", "42", "7.5"]), "?") if rng.random() < 0.4 else (w := rng.choice(["c1", "t_2", "=", "(", "and"]), w) for _ in range(rng.randint(1, 12))]
        cases[rng.choice([" ", "\n "]).join(p for p, _ in parts)] = " ".join(q for _, q in parts)
    assert values(spark, X.fingerprint, [*cases]) == [*cases.values()]


def test_fingerprint_of_a_long_literal_does_not_overflow(spark):
    assert values(spark, X.fingerprint, ["a = '" + "x''" * 50_000 + "'"]) == ["a = ?"]


def test_template(spark):
    deep = "(" * 10 + "8" + ")" * 10
    cases = {
        "delete --why\nfrom q": "DELETE FROM q", "a /*x\ny*/ /* z */ b": "a b", "where K in (5,\n'b)', f(7))": "WHERE K IN (?)", "m not in( 'q''q' )or n": "m NOT IN (?)OR n",
        "case when v then 'set' else 3 end": "CASE WHEN v THEN 'set' ELSE 3 END", "fromage, t.select, in_stock": "fromage, t.select, in_stock", "u = '/* kept */  -- too'": "u = '/* kept */  -- too'",
        "w in (select 1 from x where y in (9))": "w IN (SELECT 1 FROM x WHERE y IN (?))", f"z in {deep} and 8": "z IN (?) AND 8", "h in ('select')": "h IN (?)", "p--q\nr": "pr", "pin (4)": "pin (4)",
    }
    assert values(spark, X.template, [*cases]) == [*cases.values()]


def test_lists_of_any_depth(spark):
    def deep(n):
        return "(" * n + "8" + ")" * n

    cases = {
        f"z in {deep(14)} and 8": "z IN (?) AND 8", f"z in {deep(200)} and 8": "z IN (?) AND 8", "a in (b in (1), (c in(2)))x": "a IN (?)x",
        "a in (1, (select y in (3, (4))), z in (5)) or b in ()": "a IN (1, (SELECT y IN (?)), z IN (?)) OR b IN (?)", "a in (1, b in (2)": "a IN (1, b IN (?)", ") in (1))": ") IN (?))",
        "a in (')', 'from', /* ) */ 3) b": "a IN (?) b", "x /* in ( */ in (1)": "x IN (?)", "in\n (1) in": "IN (?) IN", "x in ('open": "x IN ('open", "a in (t.from, fromage)": "a IN (?)", "a / b in (1/2) /": "a / b IN (?) /",
        "": "", "x in (\ufdd0)\ufdd0": "x IN (?)\ufffd",
    }
    assert values(spark, X.template, [*cases]) == [*cases.values()]
    large = {"a in (" + ", ".join(f"'{i}'" for i in range(200_000)) + ")": "a IN (?)", " or ".join(f"x in ({i}, (2))" for i in range(2000)): " OR ".join(["x IN (?)"] * 2000), f"q in {deep(20_000)}": "q IN (?)"}
    assert values(spark, X.template, [*large]) == [*large.values()]


def test_lists_of_made_up_statements(spark):
    rng = random.Random(8)

    def made(depth):
        """A piece of a statement, what becomes of it, and whether it holds a sub-query."""
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            w = rng.choice(["7", "'a)'", "q.in", "=", "'in ('"])
            return w, w, False
        parts = [made(depth - 1) for _ in range(rng.randint(1, 3))]
        raw, cut, query = " ".join(p[0] for p in parts), " ".join(p[1] for p in parts), any(p[2] for p in parts)
        if kind < 0.5:
            return f"({raw})", f"({cut})", query
        if kind < 0.6:
            return f"select {raw}", f"SELECT {cut}", True
        return f"in ({raw})", f"IN ({cut})" if query else "IN (?)", query

    cases = dict(made(rng.randint(1, 20))[:2] for _ in range(300))
    assert values(spark, X.template, [*cases]) == [*cases.values()]


def test_many_words_at_once(spark):
    words = [f"w{i}x" for i in range(10_000)]
    texts = ["a w17x", "w17", "W17x", "", None, "…w9999x…", "w10000x"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    hit = contains_any(F.col("s"), words)
    assert [r[0] for r in df.orderBy("i").select(hit).collect()] == [any(w in (t or "") for w in words) for t in texts]
    assert len(df.filter(hit)._jdf.queryExecution().toString()) < 5000
    assert [r[0] for r in df.orderBy("i").select(contains_any(F.col("s"), [*words, ""])).collect()] == [t is not None for t in texts]
    assert not df.filter(contains_any(F.col("s"), [])).count()
    with pytest.raises(ValueError, match="at most"):
        contains_any(F.col("s"), [str(i) * 1000 for i in range(3000)])


def test_params(spark):
    head = "PARAMS(SEQNO, TYPE, DATA)="
    cases = {
        head + "{(0, CHAR, 'Rio')}": ["'Rio'"], head + "{(0, INT, -12), (1, CHAR, 'a, (b)'), (2, DATE, )}": ["-12", "'a, (b)'", "NULL"], head + "{(0, INT, 4)(1, INT, 5)}": ["4", "5"],
        head + "{(0, CHAR, 'l''eau')}": ["'l''eau'"], "select 1": None, head + "{}": [], head + "{(0, INT, 4), oops}": None,
    }
    assert values(spark, X.params, [*cases]) == [*cases.values()]


def test_placeholders(spark):
    cases = {
        "f(?, ?, '?')": (2, False), "g(:2, :1, ':9')": (2, True), "'??' || ?": (1, False), "no such": (0, False), "'? open": (0, False), "'don''t ?' = ?": (1, False), "v::int": (0, False), "? < :4": (4, True),
    }
    assert [tuple(v) for v in values(spark, X.placeholders, [*cases])] == [*cases.values()]


@pytest.mark.parametrize(
    ("sql", "given", "ordinal", "want"),
    [
        ("call p(?, ?, ?)", ["-4", "'x y'", "NULL"], False, "call p(-4, 'x y', NULL)"),
        ("'?' <> ?", ["'?'"], False, "'?' <> '?'"),
        ("'don''t' < ? or ?", ["8"], False, "'don''t' < 8 or ?"),
        ("'open ?", ["8"], False, "'open ?"),
        ("f(:2, :2, :1)", ["'a'", "'b'"], True, "f('b', 'b', 'a')"),
        (":4 = ?", ["8"], True, ":4 = ?"),
        ("nothing", [], False, "nothing"),
    ],
)
def test_bind(spark, sql, given, ordinal, want):
    df = spark.createDataFrame([(sql, given, ordinal)], "s string, v array<string>, o boolean")
    assert df.select(X.bind(F.col("s"), F.col("v"), F.col("o"))).first()[0] == want


def test_numbers_and_labels(spark):
    inf, nan = float("inf"), float("nan")
    assert values(spark, X.whole_ms, [1.9, -1.9, nan, inf, 1e30, -1e30]) == [1, -1, 0, 0, 2**63 - 1, -(2**63)]
    assert values(spark, X.micros, [0.0, -3.0, 0.4, 1e9, nan]) == [1, 1, 400, 60_000_000, 1]
    lows = values(spark, X.bucket_low, [1, 255, 256, 400, 401, 60000])
    assert (lows, values(spark, X.bucket_high, [1, 255, 256, 400, 401, 60000])) == ([1, 255, 256, 400, 400, 59904], [1, 255, 257, 401, 401, 60159])
    assert values(spark, X.label, ["x" * 41, "x" * 40]) == ["x" * 39 + "…", "x" * 40]
    assert values(spark, X.safe_key, ["a b/c-é_1"]) == ["a_b_c-__1"]
    assert values(spark, X.strip_mapped_ip, ["::FFFF:1.2.3.4", "::ffff:", "1.2.3.4"]) == ["1.2.3.4", "::ffff:", "1.2.3.4"]
