import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, extra=True):
    """Documents with other columns whose names clash with what operators use inside."""
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for name in ("id", "size", "node", "hash", "key", "n", "kind", "spans", "label", "rank", "component", "score", "part", "chunk", "h", "pi", "block", "_key", "_spans"):
            df = df.selectExpr("*", f"'clash' AS {name}")
    return df


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, ties."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    rows = [
        (1, None, "en", "s1", 0), (2, "", "en", "s1", 0), (3, "   \t\n", None, None, None), (4, long, "en", "s2", len(long)), (5, long, "de", "s2", len(long)),
        (6, "the quick brown fox jumps over the lazy dog today", "en", "s1", 1), (6, "the quick brown fox jumps over the lazy dog today", "en", "s1", 1),
        (None, "the quick brown fox jumps over the lazy dog today", "en", None, 1), (2**62 + 1, "password = hunter22 \U0001F600 é", None, "s3", 1), (7, "12 34", "fr", "s3", 5), (8, "one", "fr", "s1", 3),
    ]
    return make(spark, rows)


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
