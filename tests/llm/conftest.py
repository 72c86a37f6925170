import pytest

#: Nulls, empty and blank texts, ties, repeated rows, clashing names.
ODD = [
    (1, "the same text here", "en", "a"), (2, "THE same TEXT here", "en", "a"), (2, "THE same TEXT here", "en", "a"),
    (3, None, None, None), (4, "", "en", None), (None, "", None, "b"), (5, " \n\t ", "de", "b"), (6, "word", "de", "c"),
    (None, "word", "de", "c"), (7, "x " * 5000, "en", "a"), (8, "Ärger und ärger", "de", "b"),
]
EXTRA = ", size long, kept boolean, score double, `group` string, node long, text_sha256 string, __k int"


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def odd_wide(spark):
    """The same rows with columns whose names operators use themselves."""
    rows = [(*r, 1, True, 0.5, "g", 2, "s", 3) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string" + EXTRA)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
