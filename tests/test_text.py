import re

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as fn

VALID = ["TSMC", "AB", "A100", "H800", "DGX-2", "10-K", "COVID-19", "MIDDLE EAST", "NATION_0", "Brand#2", "  nvidia  ", "x" * 55]
INVALID = ["A", "x" * 56, "2024-25", "12345", "-----", "Supplier#000000001", "FORM 10-K", "Intersection Holdings", "Foreign Exchange Rates", "$12.5%", "1,000", "99.9%", "", None]


def column(spark, values, f):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(f(F.col("v"))).collect()]


def test_valid_entity(spark):
    assert column(spark, VALID + INVALID, fn.valid_entity) == [True] * len(VALID) + [False] * len(INVALID)


def test_normalisation(spark):
    assert column(spark, ["NVIDIA CORPORATION", "Nvidia Corporation", " tsmc"], fn.entity) == ["NVIDIA", "NVIDIA CORPORATION", " TSMC"]
    assert column(spark, ["depends on", None], fn.relation) == ["DEPENDS_ON", "NONE"]


def test_clean(spark):
    texts = ["a\n\nb\t c", " \x0ba\xa0b　", "x-\n  y z", "", "\n", "a\x1cb"]
    assert column(spark, texts, fn.clean) == [re.sub(r"\s+", " ", t).strip() for t in texts]
    assert column(spark, ["cut-\n  ting a-b"], lambda c: fn.clean(c, dehyphenate_first=True)) == ["cutting a-b"]


@pytest.mark.parametrize(
    ("f", "said", "want"),
    [
        (fn.parse_keywords, "tsmc, , us", ["TSMC", "", "US"]),
        (lambda c: fn.parse_keywords(c, drop_empty=True), "tsmc, , us", ["TSMC", "US"]),
        (lambda c: fn.parse_keywords(c, 3, True), '"tsmc", , us', ["TSMC"]),
        (fn.fallback_keywords, "How does NVIDIA's CUDA help developers?", ["CUDA", "DEVELOPERS"]),
    ],
)
def test_keywords(spark, f, said, want):
    assert column(spark, [said], f) == [want]


def test_keywords_or_fallback(spark):
    rows = spark.createDataFrame([("a,b", "What about memory"), (None, "What about memory"), ("chips", "q")], "r string, q string")
    assert [r[0] for r in rows.select(fn.keywords_or_fallback(F.col("r"), F.col("q"))).collect()] == [["MEMORY"], ["MEMORY"], ["CHIPS"]]


def test_refusal_and_render(spark):
    assert column(spark, ["We CANNOT conclude", f"x{fn.REFUSAL_ZH}", "fine", None, "无法得出"], fn.is_refusal) == [True, True, False, False, False]
    assert column(spark, [None, "d"], lambda c: fn.render_with_context(F.lit("A"), F.lit("R"), F.lit("B"), c)) == ["[A] - R -> [B] (Context: None)", "[A] - R -> [B] (Context: d)"]
