import pytest

#: Texts of every awkward kind.
TEXTS = [
    None,
    "",
    " \n\t ",
    "one",
    "two words",
    "The quick brown fox jumps over the lazy dog, and it's fine.\nI'll say: 'twas 1st -- x² ½ ٣٤ 漢字 🙂\u00a0\u2003end  ",
    "The quick brown fox jumps over the lazy dog, and it's fine.\nI'll say: 'twas 1st -- x² ½ ٣٤ 漢字 🙂\u00a0\u2003end  ",
    "<|endoftext|>a <|endoftext|> b\r\n\x00\x1c\x85",
    "same line here\nsame line here\nsame line here\n" * 30,
    "word " * 30000,
    "x" * 50000,
]


@pytest.fixture()
def awkward(spark):
    """Awkward documents with repeated rows, null ids, and columns whose names clash with inner ones."""
    rows = [(i if i != 3 else None, t, "en", "s", 1, "k", 7, True, "w") for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[5], rows[0]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, private boolean, words string")


@pytest.fixture()
def nothing(awkward):
    return awkward.filter("false")


@pytest.fixture()
def benchmark(spark):
    rows = [(1, "The quick brown fox jumps over the lazy dog and"), (2, None), (3, ""), (4, "two words"), (5, "two words"), (6, "absent term zzz")]
    return spark.createDataFrame(rows, "item_id long, text string")
