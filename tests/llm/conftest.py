import os

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use for columns of their own.
CLASHES = ("fp", "batch", "bucket", "hash", "size", "copies", "target", "row", "score", "rank", "component_id",
           "sequence_id", "n_words", "_text", "digest")


@pytest.fixture(autouse=True)
def package_on_workers(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


def long_text(words=60_000, seed=5):
    import random
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ra", "to", "mi", "ne", "sul", "ok"]) for _ in range(rng.randint(1, 4)))
                    for _ in range(words))


def odd_rows():
    """Nulls in every column, empty, wordless and very long texts, ties and repeated rows."""
    long = long_text()
    return [(None, None, None, None, None), (None, "some text without an id", "en", None, 5), (1, "", "en", "a", 0),
            (2, " \t\n\x0b\f\r ", "en", "a", 5), (3, "One", None, "b", 3), (4, long, "en", "b", len(long)),
            (5, "the same row twice over and over again", "en", "a", 1),
            (5, "the same row twice over and over again", "en", "a", 1),
            (6, "the same row twice over and over again", "fr", None, 1), (7, "é ü 中文 🙂   x", "fr", "c", 9),
            (8, None, None, "c", None), (9, "123 456 !!", "fr", "c", 10)]


def frame(spark, rows, clash=True):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clash else df


def values(df, *names):
    """Rows as sorted tuples."""
    return sorted((tuple(r) for r in df.select(*names).collect()), key=lambda r: tuple((x is None, x) for x in r))
