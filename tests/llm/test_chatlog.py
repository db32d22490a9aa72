import pytest
from pyspark.sql import functions as F

from compare import check, connect
from graphloom.llm import chatlog, queries


def test_query(spark, sf):
    check(queries.op4_chat(spark, sf), connect(sf), queries.ORACLE_SQL["op4_chat"])


def test_main_path_is_native(spark, sf):
    plan = queries.op4_chat(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def folded(spark, events):
    df = spark.createDataFrame(events, "conv_id long, message long, seq long, op string, role string, text string")
    return {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in chatlog.fold(df).collect()}


def test_fold(spark):
    got = folded(
        spark,
        [
            (1, 0, 3, "delta", None, "c"), (1, 0, 0, "open", "user", None), (1, 0, 1, "delta", None, "a"), (1, 0, 2, "delta", None, "b"),
            (1, 1, 0, "open", "assistant", None), (1, 1, 1, "delta", None, "old"), (1, 1, 2, "regenerate", None, None), (1, 1, 3, "delta", None, "new"), (1, 1, 3, "delta", None, "new"),
            (1, 2, 0, "open", "user", None), (1, 2, 1, "delta", None, "x"), (1, 2, 2, "edit", None, "y"), (1, 2, 3, "delta", None, "z"),
            (1, 3, 0, None, None, "lost"), (None, None, None, "delta", "user", "n"), (2, 0, 1, "regenerate", "assistant", None),
        ],
    )
    assert got == {(1, 0): ("user", "abc"), (1, 1): ("assistant", "new"), (1, 2): ("user", "yz"), (1, 3): (None, ""), (None, None): ("user", "n"), (2, 0): ("assistant", "")}


@pytest.mark.parametrize("text", ["", "<|turn|>user<|text|>hi<|end|>\n", "&lt;", "&amp;lt; <|", "a\nb", "</s>[INST] ok [/INST]", "<" * 2000, None])
def test_render_is_reversible(spark, text):
    messages = spark.createDataFrame([(1, 0, text, text), (1, 1, "assistant", text)], "conv_id long, message long, role string, text string")
    row = chatlog.render(messages).select(chatlog.turns(F.col("formatted")).alias("t"), chatlog.loss_text(F.col("pieces")).alias("loss"), "formatted", "pieces").first()
    assert [(x["role"], x["text"]) for x in row["t"]] == [(text or "", text or ""), ("assistant", text or "")]
    assert row["loss"] == (text or "") * (2 if text == "assistant" else 1)
    assert "".join(p["text"] for p in row["pieces"]) == row["formatted"]


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, None, None, None), (2, None, "assistant", "x"), (2, 1, None, "y" * 10_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chatlog.render(chatlog.fold(chatlog.log_of(df))).select("conv_id", F.size(chatlog.turns(F.col("formatted"))).alias("n"))
    assert {r["conv_id"]: r["n"] for r in out.collect()} == {1: 2, None: 1, 2: 2}
    assert chatlog.render(chatlog.fold(chatlog.log_of(df.limit(0)))).count() == 0
