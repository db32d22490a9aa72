import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and long texts, ties, repeated rows and clashing names."""
    passage = " ".join(f"shared{k} word{k * 7 % 13}" for k in range(40))
    rows = [
        (1, "a b c d e f g", "en", "s", 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \n\t ", "en", None, 4),
        (5, "A B C d e f g", None, "s", 1), (6, "word", "en", "t", 4), (7, "é" * 5000 + " " + "x" * 70_000, "fr", "t", 1),
        (8, f"first start {passage} first end here", "en", "s", 1), (9, f"other begin of text {passage} and some other tail", "en", "s", 1),
        (9, f"other begin of text {passage} and some other tail", "en", "s", 1), (None, "no id at all", "en", "s", 1), (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("id", "fp", "component", "root", "start", "words", "ids", "good", "site", "path", "text_hash", "keep", "row", "shard", "slot"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
