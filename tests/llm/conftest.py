import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"

# nulls everywhere, empty, white space, repeated rows, ties, odd characters, a long text
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (1, "The quick brown fox jumps over the lazy dog again and again", "en", "a", 10),
    (2, "", "en", "a", 0),
    (3, None, None, None, None),
    (None, "Licensed under the MIT License. and CC BY 4.0", None, "b", 3),
    (None, None, None, None, None),
    (4, "  \n\t ", "de", "b", 4),
    (5, "日本語 ▁ é 😀 \x00 don't STOP", "ja", "", 9),
    (6, "word " * 4_000, "en", "c", 20_000),
    (7, "12345 !!! ???", "en", "c", 13),
    (8, "x", "de", "a", 1),
    (9, "The quick brown fox jumps over the lazy dog again and  AGAIN", "en", "b", 10),
]


@pytest.fixture()
def odd(spark):
    """Documents of odd rows, with further columns whose names the operators use themselves."""
    names = "fp bigint, size string, shard string, row int, label_id bigint, r int, k int, times int"
    schema = f"{COLUMNS}, {names}"
    return spark.createDataFrame([(*r, 1, "s", "t", 2, 3, 4, 5, 6) for r in ROWS], schema).repartition(3)


@pytest.fixture()
def none(odd):
    return odd.filter("false")
