import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, row int, score string, bucket long, id string, kept string"


def row(doc_id, text, **more):
    return (doc_id, text, more.get("lang"), None, None if text is None else len(text), "d", 1, "s", 2, None, "k")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    rows = [
        row(5, "one two three four five six seven"),
        row(3, "one  two three\nfour five six seven"),
        row(3, "one  two three\nfour five six seven"),
        row(None, "one two three four five six seven"),
        row(None, None),
        row(9, None),
        row(8, ""),
        row(7, " \t\n "),
        row(2**60 + 1, "Unicode é ñ 中文 ́ ẞ İ don't    x"),
        row(4, "word " * 30000),
        row(6, "x" * 50000),
        row(1, "Licensed under the MIT License. Mail bob@mail.com or +1 (222) 333-4444."),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def word_file():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def piece_file():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
