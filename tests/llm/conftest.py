import pytest

#: Rows that every operator on documents has to stand: nulls, empty and long texts, repeated rows and ids.
ODD = [
    (1, "the cat sat on the mat and the dog ran off"), (2, None), (3, ""), (4, " \t\n "), (5, "one two"),
    (6, "one two"), (7, "one two three four five six " * 3000), (7, "another text under the same id"),
    (None, "a text without an id that has some words"), (1, "the cat sat on the mat and the dog ran off"), (9, "漢字 🎉 é\x0b\x0cx"),
]


@pytest.fixture
def odd(spark):
    """The odd rows with extra columns whose names clash with what operators add."""
    rows = [(i, t, "en", "s", 0, "x", 1.0, 7) for i, t in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, found string, score double, n_words long")


@pytest.fixture
def docs(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
