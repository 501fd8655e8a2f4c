import pytest
from pyspark.sql import functions as F

from stewardry.llm.frames import importable, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir(spark):
    importable(spark)
    return SF


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    return table(spark, sf_dir, "documents").cache()


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, `keep id` string"


@pytest.fixture(scope="session")
def odd(spark, sf_dir):
    """Nulls, empty, blank, very long, tied and repeated rows, and columns with clashing names."""
    long_word, long_text = "x" * 300_000, "lorem ipsum dolor sit amet " * 40_000
    rows = [
        (1, "One two three four five six seven.", "en", "a", None),
        (2, "one two three  four\nfive six seven.", "en", None, 5),
        (3, None, None, None, None),
        (4, "", "en", "a", 0),
        (5, " \t\n\x0b\x0c\r ", "fr", "a", 7),
        (6, long_text, "en", "a", 1),
        (7, long_word, "de", "a", 1),
        (8, "12 34 !?", None, "b", 8),
        (9, "short", "en", "b", 5),
        (10, "Short", "en", "b", 5),
        (11, "日本語 テキスト é\u00a0ñ \u3000 x 🙂", "ja", "b", 5),
        (12, "twin text here", "en", "b", 5),
        (12, "twin text here", "en", "b", 5),
        (None, "no id at all, only text", "en", "b", 5),
        (13, "one two three four five six seven eight nine ten eleven twelve thirteen", "en", "b", 5),
    ]
    return spark.createDataFrame([(*r, 0.5, "own") for r in rows], SCHEMA).cache()


@pytest.fixture(scope="session")
def nothing(spark, odd):
    return odd.filter(F.lit(False))


def rows(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: repr(sorted(r.items(), key=lambda x: (x[0] != key, x[0]))))
