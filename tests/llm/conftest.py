import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 977} is{i}" for i in range(12_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, " \n\t ", "en", "s", 4),
    (4, "one", "en", "s", 3),
    (5, "The quick brown fox jumps over the lazy dog near the river bank", "en", "s", 1),
    (6, "The quick brown fox jumps over the lazy dog near the river bank", "en", "s", 1),
    (6, "The quick brown fox jumps over the lazy dog near the river bank", "en", "s", 1),
    (None, "a row without an id has a text", "en", None, 5),
    (7, LONG, "en", "s", len(LONG)),
    (9, "Œuvre 漢字 𝒳𝒴 mixed\u00a0text\x0bwith odd spaces ünder the MIT license, ok", "de", "s", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with operators' own."""
    rows = [(*r, 1, 2.0, "x") for r in ODD]
    return spark.createDataFrame(rows, DOCUMENTS + ", k bigint, score double, words string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
