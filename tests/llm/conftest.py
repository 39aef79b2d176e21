import pytest

# Words of every kind of trouble: nothing, blanks, no letters, other scripts, very long.
TROUBLE = [None, "", "   \n", "123 456", "%%% !!!", "ünïcödé Ωμέγα 漢字 \U0001f600", "a" * 40_000, "word " * 8_000]


@pytest.fixture(scope="session")
def trouble(spark):
    """Ids repeat and are null, columns clash with the results' names."""
    rows = [(i if i else None, t, "en", float(i)) for i, t in enumerate(TROUBLE)] + [(7, "again", None, 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, score double")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
