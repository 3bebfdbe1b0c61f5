import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from (id, text) pairs, or from whole rows."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src0", len(t) if t is not None else None) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, blanks, one word, repeated rows, equal ids, other scripts, a very long text."""
    return [
        (1, None), (2, ""), (3, " \t\n "), (4, "word"), (5, "one two three four"), (5, "one two three four"),
        (None, "a text without an id that is long enough to have five word shingles"), (7, "Ünïcode wörds ünd 漢字 mixed with ASCII words in a row of more than ten"),
        (8, "!!! ... ???"), (9, " ".join(f"w{i}" for i in range(60_000))), (-3, "negative ids are ids too"), (10, "x" * 100_000),
    ]
