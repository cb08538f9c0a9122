import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows (doc_id, text[, source]) as a table of documents with columns whose names might clash."""
    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, "x", 1) for r in rows]
        return spark.createDataFrame(full, SCHEMA + ", digest int, run string, n int")

    return make


@pytest.fixture(scope="session")
def odd():
    """Null and empty texts, ties, repeated rows, null ids and a very long text."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t"), (4, "a b c"), (5, "a b c"), (5, "a b c"), (None, "a  b c"), (6, "ab c "), (7, long), (8, long + " end"), (9, "z" * 5000), (10, "é ß 日本 👍 <|endoftext|>"), (None, None)]
