import pytest

AWKWARD = [
    (1, "one two three", "en", "a", 13),
    (1, "one two three", "en", "a", 13),
    (2, None, None, None, None),
    (3, "", "de", "b", 0),
    (4, "   \n\t ", "de", "b", 6),
    (None, "a row without a number", "fr", "a", 22),
    (5, "word " * 30_000, "en", "a", 150_000),
    (6, "Ünïcödé ßtraße é", None, "c", 16),
    (7, "!!! ### $$$", "es", "c", 11),
]


@pytest.fixture
def awkward(spark):
    """Nulls in any column, empty and very long texts, repeated rows, and extra columns with the names of internal ones."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["id", "label", "name", "n", "p", "score", "node", "bucket", "chunk", "shard", "rank", "units", "unit", "component", "start_word", "take", "w", "v"]
    return df.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture
def nothing(awkward):
    return awkward.limit(0)
