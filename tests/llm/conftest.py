import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rid string, _doc int, `a.b` string, size string, h int, taken string, _text int"


def awkward_rows():
    """Nulls, empty and long texts, ties, repeated rows; extra columns with names that operators might use."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "Delta", "été", "naïve", "cc", "by", "all", "rights", "reserved", "x" * 30, "7", "#*$"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_text = prose(60_000)
    shared = prose(120)
    texts = [None, "", " \t\n", "one", prose(3), prose(60), prose(200), long_text, shared, shared, prose(20) + "\n" + shared, shared + "\n" + shared, "a" * 3000, "line\nline\n\nline\n", "e\u0301 \u2003 \U0001f600 <|endoftext|> 漢字"]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), "x", 1, None, "9", 4, "t", 0) for i, t in enumerate(texts)]
    return [*rows, rows[6], rows[6], rows[5], (None, "no id here", "en", "s1", 10, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    """The smallest documents table."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
