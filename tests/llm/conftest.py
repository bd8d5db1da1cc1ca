import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, _group string, size string, anchor int, media int, _drop int, _times int"


@pytest.fixture
def documents(spark):
    """Makes documents of (doc_id, text, source) rows, with further columns whose names operators use inside."""

    def make(rows):
        return spark.createDataFrame([(d, t, "en", s, len(t or ""), 1, "g", "s", 1, 1, 1, 1) for d, t, s in rows], SCHEMA).repartition(3)

    return make


#: Nulls, empty and blank texts, ties, repeated rows, a long text.
AWKWARD = [
    (1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, "one two three", "b"), (4, "one two three", "b"), (None, "no id here", "c"), (5, "ünï çødé 漢字 words " * 3000, None),
    (6, "one two three", None), (7, "\x00 odd \x1f bytes \r\n", "a"),
]


@pytest.fixture
def awkward(documents):
    return documents(AWKWARD)


@pytest.fixture
def nothing(documents):
    return documents([(1, "x", "a")]).filter("doc_id < 0")
