import pytest


@pytest.fixture(scope="session")
def rows_of(spark):
    """A table from rows of (doc_id, text, source); columns the operators also use clash by name."""

    def make(rows, kind="doc_id long, text string, source string"):
        made = spark.createDataFrame(rows, kind)
        for name in ("_key", "class", "bucket", "Score", "_place", "size", "_tie", "_part"):
            made = made.selectExpr("*", f"'x' as `{name}`")
        return made

    return make


#: Nulls, empty and repeated rows, ties and a very long text.
ODD = [
    (1, "", "a"),
    (2, None, None),
    (3, " \n\t", "a"),
    (4, "one", "b"),
    (5, "One", "b"),
    (6, "a b c d e f g h", None),
    (6, "a b c d e f g h", None),
    (7, "a b c d e  f g\nh", "a"),
    (8, "x" * 200_000, "c"),
    (9, "word " * 300_000, "c"),
    (None, "nobody knows me at all here", "c"),
    (None, None, "c"),
    (10, "ünïcödé 日本語 \xa0 \x1c <|endoftext|> tail", "b"),
]


@pytest.fixture(scope="session")
def odd():
    return ODD
