import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text), with a column whose name operators might use themselves."""

    def run(rows):
        full = [(i, t, None, "s", None if t is None else len(t), 1.5, "x") for i, t in rows]
        return spark.createDataFrame(full, DOCS + ", score double, row string").repartition(3)

    return run


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and blank texts, very long ones, ties and repeated rows."""
    long = " ".join(f"word{i % 977} other{i % 13}." for i in range(30_000))
    return [(1, "Some plain words stand here, and a few more follow them."), (2, None), (3, ""), (4, "   \n\t "), (5, long), (5, long), (None, "A text without an id."), (None, None), (6, "é́ \U0001f600 <|endoftext|> it's e.g. x,.y \x85 ﬁ"), (7, "Some plain words stand here, and a few more follow them.")]
