import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, cell string, fp string, _size long, row string"


def make(spark, rows):
    """Documents from (doc_id, text, source) with columns whose names the operators use themselves."""
    full = [(i, t, "en", s, None if t is None else len(t), -1, -1.0, "x", "y", -2, "z") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def edge_rows():
    """Null ids, texts and sources, empty and blank texts, repeated rows, copies, a very long text and a very long word."""
    words = "one two three four five six seven eight nine ten".split()
    prose = " ".join(words[i * 7 % 10] + str(i * i % 37) for i in range(60))
    long_text = " ".join(f"w{i * 17 % 5003}" for i in range(40_000))
    return [
        (1, prose, "a"), (2, prose, "b"), (2, prose, "b"), (3, None, "a"), (4, "", None), (5, " \n\t ", "a"), (None, prose + " end", "c"), (None, "x", None),
        (6, long_text, "a"), (7, "y" * 100_000, "c"), (8, long_text + " tail", "b"), (9, "Ünï çödé words\n\nline\nline\n" * 9, "a"), (10, prose[:120], "a")]


@pytest.fixture
def edge_docs(spark, edge_rows):
    return make(spark, edge_rows)
