import pytest


@pytest.fixture
def docs(spark):
    """Nulls in every column, empty and blank texts, repeated rows, ties, a very long text and columns with names of the operators' own."""
    base = "The quick brown fox jumps over the lazy dog near the river bank while seven small birds sing in the old tree."
    rows = [
        (1, base, "en", "a", "x"),
        (2, base, "en", "a", None),
        (2, base, "en", "a", None),
        (3, None, None, None, "y"),
        (4, "", "en", "b", "z"),
        (5, " \t\n ", "de", "b", "z"),
        (6, base + " And then some more words follow here, and a last one.", "en", "a", "x"),
        (7, " ".join(f"word{i % 977}x{i % 13}" for i in range(40_000)), "fr", "c", "x"),
        (None, base, "en", "a", "x"),
        (8, "é" * 60 + " ñandú", "es", "c", "x"),
        (9, "aaaa" * 100, "en", "c", "x"),
        (10, "b" + "aaaa" * 50, "en", "c", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, hits string")


@pytest.fixture
def no_docs(docs):
    return docs.limit(0)
