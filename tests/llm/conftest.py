import pytest

from llm_texts import prose

#: Names that the operators use inside, to clash with.
EXTRA = "id text_ row key n tag h v cls kept found score ids block keys lang_pred __row __in __text".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of rows (doc_id, text[, lang[, source]]) with columns whose names clash with the operators' own."""

    def build(rows):
        full = [(*r, *[None] * (4 - len(r)), len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        from pyspark.sql import functions as F

        return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(EXTRA)])

    return build


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = prose(1, 30_000)
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n ", "en", "a"),
        (4, "one", None, "a"),
        (5, long, "en", "b"),
        (6, long, "en", "b"),
        (6, long, "en", "b"),
        (None, "two words", "en", None),
        (7, "x" * 50_000, "de", "a"),
        (8, "Grüße 😀 café\x85\x1c İΣ", "de", "a"),
    ]
