import pytest

WORDS = "the of and that this from with which there other about their would these".split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names clash with the operators' own."""
    rows = [
        (1, "a plain text of some words, and more of them.", "en", "s", 1, 0, "x"),
        (1, "a plain text of some words, and more of them.", "en", "s", 1, 0, "x"),
        (2, None, "en", None, None, None, None),
        (3, "", None, "s", 0, 1, "y"),
        (None, "a text without an id, with some words too", "en", "s", 1, 2, "z"),
        (4, "  \n\t ", "en", "s", 5, 3, None),
        (5, " ".join(WORDS[i * i % 14] for i in range(30_000)), "en", "s", 7, 4, "w"),
        (6, "12 34 !!", "en", "s", 8, 5, "v"),
        (7, "été ñandú straße   日本語 \U0001f600 text", None, "s", 9, 6, "u"),
        (8, "a plain text of some words, and more of them.", "de", "t", 1, 0, "x"),
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, start long, range string"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id < 0")
