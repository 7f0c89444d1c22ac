import pytest

ODD = [
    (1, "Plain words in a row, nothing to see here at all."), (2, None), (3, ""), (4, "   \n\t "), (5, "word " * 30_000), (6, "Plain words in a row, nothing to see here at all."), (7, "é ñ ß İ ΑΣ 日本語 🎉 don't <|endoftext|> x"),
    (8, "mail bob.smith@example.org or 10.0.0.1, card 4111 1111 1111 1111, call +49 30 1234567."),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with null, empty, blank, very long and repeated texts, and columns with clashing names."""
    rows = [(k, t, "en", "s", "x", "y", 0, "z") for k, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, sig string, component string, rank int, keys string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
