import pytest

SCHEMA = "doc_id long, text string, score double, key long, n_words string, leaks int, _key int, host string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, clashing names."""
    para = " ".join(f"word{i}" for i in range(60))
    texts = [
        (None, None),
        (None, para),
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, para),
        (4, para),
        (4, "another text with the same id"),
        (5, "a\n" + para + "\nb"),
        (6, LONG),
        (7, "x"),
        (8, "é ß 日本 🎉 <|endoftext|>"),
        (9, "A B C D E F G H " * 30),
    ]
    return spark.createDataFrame([(i, t, None, 1, "n", 2, 3, "h") for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf="sf0.001"):
    return spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
