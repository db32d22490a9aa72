import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from graphloom.operators import backends, experiment, ranking, triples, vectors
from graphloom.sources import sinks, tables
from graphloom.streaming import incremental


def test_files_and_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two|")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    (tmp_path / "c.txt").write_bytes(b"no")
    found = tables.files(spark, str(tmp_path))
    assert found.count() == 2

    def extract(raw):
        if raw == b"bad":
            raise ValueError
        return raw.decode().split("|")

    pages = tables.pages(found, extract)
    assert sorted((r["doc_id"], r["page_idx"], r["text"]) for r in pages.collect()) == [("a.pdf", 0, "one"), ("a.pdf", 1, "two"), ("a.pdf", 2, "")]
    assert tables.page_range(pages, first=1, last=2).count() == 1
    assert tables.document_text(pages, "doc_id", "page_idx", F.col("text")).first()["text"] == "onetwo"


def test_questions_and_results(spark, tmp_path):
    q = [{"id": "Q1", "category": "c", "difficulty": "Multi-hop", "question": "why", "expected_strategic_intent": "i"}]
    (tmp_path / "q.json").write_text(json.dumps(q))
    assert tables.questions(spark, str(tmp_path / "q.json")).first()["question"] == "why"
    assert tables.results(spark, str(tmp_path / "none")).count() == 0
    assert tables.collection(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(AnalysisException):
        tables.results(spark, str(tmp_path / "none"), required=True)


def test_collection_inserts_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "c")
    new = spark.createDataFrame([("a", "x", [1.0]), ("a", "x", [1.0]), ("b", "y", [2.0])], "id string, document string, embedding array<float>")
    sinks.add_vectors(new, path)
    sinks.add_vectors(new.withColumn("document", F.lit("changed")), path)
    assert sorted((r["id"], r["document"]) for r in tables.collection(spark, path).collect()) == [("a", "x"), ("b", "y")]


def test_query_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(20)], "id long, embedding array<float>")
    asked = rows.where("id < 7").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    whole = sorted(vectors.nearest(asked, rows, 3).collect())
    monkeypatch.setattr(vectors, "QUERIES_AT_ONCE", 2)
    monkeypatch.setattr(vectors, "VECTORS_AT_ONCE", 6)
    assert sorted(vectors.nearest(asked, rows, 3).collect()) == whole and whole[0][:3] == (0, 1, 0)


def test_replies(spark):
    said = ['{"triples":[{"source":"A","relation":"r","target":"B"},{"target":"C"}]}', "no json", '{"triples":[]}', None]
    df = spark.createDataFrame(list(enumerate(said)), "k int, reply string")
    assert [tuple(r) for r in triples.parse_replies(df, "k", F.col("reply")).orderBy("item").collect()] == [(0, 0, "A", "r", "B", None), (0, 1, None, None, "C", None)]


def test_backends(spark):
    questions = spark.createDataFrame([(1, "What about memory chips"), (2, "boom")], "query_id long, question string")

    def keywords():
        def call(frame):
            if "boom" in set(frame["question"]):
                raise RuntimeError
            return frame["question"].map(lambda q: "alpha, be")

        return call

    one = questions.where("query_id = 1")
    assert backends.Backends().with_keywords(one).first()["keywords"] == ["MEMORY", "CHIPS"]
    assert backends.Backends(keywords=keywords).with_keywords(one).first()["keywords"] == ["ALPHA"]
    assert backends.Backends(keywords=keywords).with_keywords(questions.where("query_id = 2")).first()["keywords"] == ["BOOM"]
    answered = backends.Backends(answer=lambda: lambda f: 1 / 0).with_answer(one, F.lit("x")).first()["answer"]
    assert answered == "Error: division by zero"


def test_one_bad_row_fails_alone(spark):
    """Of 200 questions one fails; the others of its frame are answered."""
    rows = spark.range(200).select(F.col("id").alias("query_id"), F.lit("c").alias("context")).coalesce(1)

    def answer():
        def call(frame):
            if 77 in set(frame["query_id"]):
                raise RuntimeError("bad")
            return frame["query_id"].map(str)

        return call

    got = {r["query_id"]: r["answer"] for r in backends.Backends(answer=answer).with_answer(rows, F.lit("x")).collect()}
    assert got == {k: "Error: bad" if k == 77 else str(k) for k in range(200)}


def test_engine_keywords(spark):
    questions = spark.createDataFrame([(1, "tsmc, , us"), (2, "boom")], "query_id long, question string")

    def keywords():
        def call(frame):
            if "boom" in set(frame["question"]):
                raise RuntimeError
            return frame["question"]

        return call

    made = backends.Backends(keywords=keywords).with_keywords(questions, engine=True)
    assert {r["query_id"]: r["keywords"] for r in made.collect()} == {1: ["TSMC", "", "US"], 2: []}


def test_results_round_trip(spark, tmp_path):
    """Five records written by the sink are five read back, appended ones too; and an array of an older file."""
    long = [(k, "c", f"q{k}\nline", arch, f"a{k}", k % 5 + 1, 2, 3) for k in range(5) for arch in ("baseline_vector_rag", "proposed_graph_rag")]
    results = spark.createDataFrame(long, "query_id long, category string, question string, arch string, answer string, faithfulness int, relevance int, precision int")
    made, path = experiment.records(results), str(tmp_path / "results")
    assert made.schema.simpleString() == tables.results(spark, str(tmp_path / "none")).schema.simpleString()
    sinks.append_results(made.where("id < 3"), path)
    sinks.append_results(made.where("id >= 3"), path)
    assert sorted(map(str, tables.results(spark, path).collect())) == sorted(map(str, made.collect())) and made.count() == 5
    old = [r.asDict(recursive=True) for r in made.collect()]
    (tmp_path / "old.json").write_text(json.dumps(old))
    assert sorted(map(str, tables.results(spark, str(tmp_path / "old.json"), array=True).collect())) == sorted(map(str, made.collect()))


def test_unusable_vectors_and_text_ids(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, None]), ("e", [1.0]), ("f", [float("nan"), 1.0]), ("g", [0.0, 2.0]), ("a", [1.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [2.0])], "query_id long, query array<float>")
    found = sorted(tuple(r) for r in vectors.nearest(asked, df, 9).collect())
    assert found == [(1, 1, "a", 0.0), (1, 2, "a", 0.0), (1, 3, "b", 1.0), (1, 4, "g", 5.0), (3, 1, "e", 1.0)]
    assert sorted(r["id"] for r in vectors.nearest(asked, df, 9, "cosine").where("query_id = 1").collect()) == ["a", "a", "g"]
    assert vectors.nearest(asked.limit(0), df).count() == 0 and vectors.nearest(asked, df.limit(0)).count() == 0


def test_reports(spark):
    rows = spark.createDataFrame([("a", 4, 1, 1), ("a", 5, 2, 2), ("a", None, 3, 3)], "arch string, faithfulness int, relevance int, precision int")
    summary = experiment.report(rows, ["arch"])
    assert summary.first()["faithfulness"] == 3.0 and summary.first()["n"] == 3
    assert experiment.report(rows.limit(0), []).first()["faithfulness"] == 0.0
    assert experiment.latex_rows(summary).first()["line"] == r"a & 3.00 & 2.00 & 2.00 \\"
    assert experiment.latex_table(summary).count("\\hline") == 3
    assert ranking.with_sentinel(rows.select(F.lit(1).alias("query_id")).limit(1), spark.createDataFrame([], "query_id int, answer string"), "answer", "none").first()["answer"] == "none"


def test_resume_across_runs(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    stream = spark.readStream.schema("id string, x int").json(str(source))
    each = lambda df, n: df.write.mode("append").parquet(out)
    for k, ids in enumerate((["a", "b", "a"], ["b", "c"])):
        (source / f"{k}.json").write_text("\n".join(json.dumps({"id": i, "x": k}) for i in ids))
        incremental.run_available(stream, each, str(tmp_path / "cp"), "id")
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_upsert_stream(spark, tmp_path):
    source, path = tmp_path / "in", str(tmp_path / "graph")
    source.mkdir()
    stream = spark.readStream.schema("src string, rel string, dst string, description string, seq int").json(str(source))
    for k, rows in enumerate(([("A", "R", "B", "one", 1), ("A", "R", "B", "two", 2)], [("A", "R", "B", "three", 3), ("C", "R", "D", "x", 4)])):
        (source / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("src", "rel", "dst", "description", "seq"), r, strict=True))) for r in rows))
        incremental.run_available(stream, incremental.upsert_each(path), str(tmp_path / "cp"))
    last = spark.read.parquet(f"{path}/version=1")
    assert sorted((r["src"], r["description"]) for r in last.collect()) == [("A", "three"), ("C", "x")]


def test_sessions(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "/reset"), (1, 3, "user", "c"), (2, 0, "user", "z")]
    (source / "0.json").write_text("\n".join(json.dumps(dict(zip(("conv_id", "turn", "role", "text"), r, strict=True))) for r in rows))
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").json(str(source))
    query = incremental.sessions(stream, 2).writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["conv_id"], r["turn"]): r["window"] for r in spark.table("sessions").collect()}
    assert got == {(1, 0): "user: a", (1, 1): "user: a\nassistant: b", (1, 2): "", (1, 3): "user: c", (2, 0): "user: z"}
