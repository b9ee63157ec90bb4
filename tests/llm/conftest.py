import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use inside
    *[T.StructField(n, T.StringType()) for n in ("id", "n", "key", "h", "rank", "words", "component_id")],
])


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table with clashing extra columns from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src1", None, *["x"] * 7) for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, ties, a null id and a very long text."""
    base = " ".join(f"alpha{i}" for i in range(120))
    return [
        (1, base), (2, base.upper()), (3, base + " tail"), (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "One"), (9, LONG), (9, LONG), (None, base), (None, None), (10, "é É ÀB c"), (11, "x" * 5000),
        (12, "lone " + base), (13, "a b"), (-3, "a b"), (14, "\x1c \x85 　"), (2**40, LONG + " end"),
    ]
