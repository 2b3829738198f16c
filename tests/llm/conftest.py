import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """NULLs in every column, empty and blank texts, repeated rows, ties, a long text, columns whose names clash."""
    words = " ".join(f"word{i % 97} of{i % 31}" for i in range(30_000))
    near = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    rows = [
        (1, near, "en", "a", 1),
        (2, near, "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n ", "en", "b", 0),
        (6, words, "en", None, 5),
        (None, near + " end", "en", "c", 2),
        (7, "kurz", "de", "c", 2),
        (8, "Zeile eins\nZeile eins\nZeile zwei ▁ ist da \U0001f600", "de", "c", 2),
        (8, "Zeile eins\nZeile eins\nZeile zwei ▁ ist da \U0001f600", "de", "c", 2),
        (9, near + " end", "en", "a", 2),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ", size int, score int, id int, key int, target int, root int, v int, bucket int, line int, words int"
    data = [(*r, *range(10)) for r in rows]
    return spark.createDataFrame(data, schema + extra)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)


@pytest.fixture(scope="session")
def some_labels(spark):
    rows = [(1, 1, 0), (2, 1, 0), (4, 0, 0), (7, None, 0), (8, 0, 1), (8, 1, 1), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
