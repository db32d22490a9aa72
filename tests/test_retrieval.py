import json

import pytest
from pyspark.sql import functions as F

from graphloom import cli
from graphloom.operators import experiment
from graphloom.operators.backends import Backends
from graphloom.plans import retrieval
from graphloom.sources import sinks, tables

PAGES = [
    ("a.txt", k, f"Memory feeds accelerators on page {k}. Foundries make chips for everyone. Export rules limit sales abroad.") for k in range(4, 8)
] + [("b.txt", 6, "Chips need memory always. 12345 is invalid here."), ("b.txt", 7, None)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "doc_id string, page_idx int, text string")


@pytest.fixture(scope="module")
def asked(spark):
    rows = [(1, "Which foundries make chips", "supply"), (2, "What limits export sales", "rules"), (3, "zzzz qqqq", "nothing")]
    return spark.createDataFrame(rows, "query_id long, question string, intent string")


def test_build_graph(spark, pages):
    edges, bad = retrieval.build_graph(pages)
    got = {(r["src"], r["rel"], r["dst"]): (r["source"], r["page"]) for r in edges.collect()}
    assert got["FOUNDRIES", "MAKE", "CHIPS"] == ("a.txt", "8") and got["CHIPS", "NEED", "MEMORY"] == ("b.txt", "7")
    assert {r["source"] for r in bad.collect()} == {"12345"}
    again, _ = retrieval.build_graph(pages, existing=edges)
    assert sorted(map(str, again.collect())) == sorted(map(str, edges.collect()))


def test_build_graph_with_a_model(spark, pages):
    def extract():
        return lambda frame: frame["text"].map(lambda t: json.dumps({"triples": [{"source": "TSMC", "relation": "makes", "target": "Chips", "description": "d"}]}))

    edges, _ = retrieval.build_graph(pages, Backends(extract=extract))
    assert [(r["src"], r["rel"], r["dst"], r["description"]) for r in edges.collect()] == [("TSMC", "MAKES", "CHIPS", "d")]


def test_experiment(spark, pages, asked):
    edges, _ = retrieval.build_graph(pages)
    collection = retrieval.build_collection(pages)
    assert sorted(r["id"] for r in collection.collect()) == ["baseline_chunk_000000", "baseline_chunk_000001"]
    out = retrieval.run_experiment(asked, asked.where("query_id = 2").select("query_id"), collection, edges).toPandas().set_index(["query_id", "arch"])
    assert sorted(set(out.index.get_level_values(0))) == [1, 3] and len(out) == 4
    assert "[FOUNDRIES] -MAKE-> [CHIPS]" in out.loc[(1, retrieval.PROPOSED), "context"]
    assert out.loc[(3, retrieval.PROPOSED), "answer"] == experiment.NO_CONTEXT
    assert out[list(experiment.METRICS)].isin(range(1, 6)).all().all()


def test_experiment_resumes_from_records(spark, pages, asked, tmp_path):
    """What a run stored is not run again; the judge's context has line ends, not the prompt's rules."""
    edges, _ = retrieval.build_graph(pages)
    collection, path = retrieval.build_collection(pages), str(tmp_path / "results")
    known = asked.withColumn("category", F.lit("c"))
    judge = Backends(judge=lambda: lambda f: ["---" in c and "rules" or '{"faithfulness_score": 1}' for c in f["context"]])
    first = retrieval.run_experiment(known.where("query_id < 3"), tables.results(spark, path), collection, edges, judge)
    rows = first.join(known.select("query_id"), "query_id")
    assert rows.where("faithfulness = 1").count() == rows.count() == 4
    sinks.append_results(experiment.records(rows), path)
    rest = retrieval.run_experiment(known, tables.results(spark, path), collection, edges)
    assert {r["query_id"] for r in rest.select("query_id").collect()} == {3}


def test_chat_turn(spark, pages):
    edges, _ = retrieval.build_graph(pages)
    messages = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", f"m{k}") for k in range(6)] + [(1, 6, "user", "Which foundries make chips"), (2, 0, "user", "Which foundries make chips")], "conv_id long, turn long, role string, text string")
    asked = spark.createDataFrame([(1, "Which foundries make chips"), (2, "Which foundries make chips")], "query_id long, question string")

    def model():
        return lambda f: ["Cannot conclude." if len(p) == 2 else p[0]["content"] for p in f["prompt"]]

    answers, lit = retrieval.chat_turn(messages, asked, edges, Backends(chat=model))
    got = {r["conv_id"]: r for r in answers.collect()}
    assert [m["content"] for m in got[1]["prompt"]][1:] == ["m3", "m4", "m5", "Which foundries make chips"]
    assert "[FOUNDRIES] -MAKE-> [CHIPS]" in got[1]["answer"] and not got[1]["refused"]
    assert got[2]["refused"] and got[2]["context"] == ""
    edges_lit = {(r["conv_id"], r["src"], r["dst"]) for r in lit.collect()}
    assert (1, "FOUNDRIES", "CHIPS") in edges_lit and {c for c, *_ in edges_lit} == {1}


def test_judge_replies(spark, asked):
    replies = {"1": '{"faithfulness_score": 4, "relevance_score": 5, "context_precision_score": 3}', "2": "", "3": "no json"}
    rows = asked.select(F.col("query_id").cast("string").alias("question"), "intent", F.lit("c").alias("context"), F.lit("a").alias("answer"))
    judged = Backends(judge=lambda: lambda f: f["question"].map(replies)).with_judgement(rows).toPandas().set_index("question")
    assert judged.loc["1", ["faithfulness", "relevance", "precision"]].tolist() == [4, 5, 3] and judged.loc["2", "error"] == "empty reply"
    assert judged.loc[["2", "3"], "faithfulness"].isna().all()
    failed = Backends(judge=lambda: lambda f: 1 / 0).with_judgement(rows).first()
    assert (failed["faithfulness"], failed["relevance"], failed["precision"]) == (0, 0, 0)


def test_command_line(spark, sf, tmp_path, capsys):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text("Some words. " * 300)
    cli.main(["build", "--raw_dir", str(tmp_path / "in"), "--db_dir", str(tmp_path / "db")])
    assert tables.collection(spark, str(tmp_path / "db")).count() > 2
    cli.main(["query", "graph_stats", "--tables", sf])
    assert "relationships" in capsys.readouterr().out
