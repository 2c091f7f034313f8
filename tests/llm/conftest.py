import pytest
from pyspark.sql import types as T

WORDS = "stone river cloud maple winter signal copper garden bright hollow lantern meadow silver timber velvet window yellow anchor basket candle".split()


@pytest.fixture(scope="session")
def docs_schema():
    return T.StructType.fromDDL("doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, number string, line int, hash string, key bigint, id bigint, node bigint, v double, w double, sig string"
    long_text = " ".join(WORDS[k % 20] + str(k) for k in range(40_000)) + "\n" + "a long last line of some words"
    extra = (None, 1, "h", 2, 3, 4, 5.0, None, "s")
    rows = [
        (1, "the quick river runs over the old stone bridge at noon\nand a second line of this text", "en", "a", 5, *extra),
        (1, "the quick river runs over the old stone bridge at noon\nand a second line of this text", "en", "a", 5, *extra),
        (2, "", "en", "a", 0, *extra),
        (3, None, "en", None, None, *extra),
        (None, "the quick river runs over the old stone bridge at noon\nand a second line of this text", None, "b", 7, *extra),
        (None, None, None, None, None, *([None] * 9)),
        (4, "   \n\t\n", "fr", "b", 6, *extra),
        (5, long_text, "en", "a", len(long_text), *extra),
        (6, long_text, "en", "a", len(long_text), *extra),
        (7, "É ü 漢字 – “quoted”\nthe quick river runs over the old stone bridge at noon", "de", "c", 9, *extra),
        (8, "one", "en", "a", 3, *extra),
    ]
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def none(odd):
    """An empty table of the same columns."""
    return odd.limit(0)
