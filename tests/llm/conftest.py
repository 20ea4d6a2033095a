import pytest
from pyspark.sql import types as T

DOC = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that the operators use for themselves
        *[T.StructField(n, T.StringType()) for n in ("id", "score", "node", "th", "i", "shard", "component_id")],
    ]
)


@pytest.fixture
def docs(spark):
    """Make a documents table with clashing extra columns from (id, text[, lang[, source]])."""

    def make(rows):
        full = []
        for r in rows:
            r = [*r, None, None][:4] if len(r) < 4 else list(r)
            full.append((r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1]), *["x"] * 7))
        return spark.createDataFrame(full, DOC)

    return make


ODD = [
    (None, "a row without an id and some words in it"),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "word"),
    (5, "the same words again and again here"),
    (5, "the same words again and again here"),
    (6, "the same words again and again here"),
    (7, "long text " * 20_000),
    (8, "&&& ### 12 34"),
    (9, "日本語 текст ñandú"),
]
