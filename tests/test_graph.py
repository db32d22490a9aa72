from itertools import product

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import graph, viz

MICRO = [("A", "R1", "B"), ("A", "R2", "B"), ("B", "R1", "C"), ("D", "R1", "C"), ("D", "R1", "D"), ("E", "R1", "F")]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(MICRO, "src string, rel string, dst string").cache()


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, pos int, keyword string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_stats_and_degrees(spark, edges):
    assert rows(graph.stats(graph.vertices(edges), edges), "nodes", "relationships") == [(6, 6)]
    none = edges.limit(0)
    assert rows(graph.stats(graph.vertices(edges), none), "nodes", "relationships") == [(0, 0)]
    assert rows(graph.stats(graph.vertices(edges), none, true_stats=True), "nodes", "relationships") == [(6, 0)]
    assert dict(rows(graph.degrees(edges), "id", "degree")) == {"A": 2, "B": 3, "C": 2, "D": 3, "E": 1, "F": 1}


def test_neighbours_are_flipped(spark, edges):
    seeds = graph.seeds(graph.vertices(edges), asked(spark, (1, 0, "C")))
    assert rows(graph.neighbours(edges, seeds), "src", "rel", "dst") == [("C", "R1", "B"), ("C", "R1", "D")]
    assert rows(graph.neighbours(edges, seeds, oriented=True), "src", "rel", "dst") == [("B", "R1", "C"), ("D", "R1", "C")]


def test_paths(spark, edges):
    seeds = graph.seeds(graph.vertices(edges), asked(spark, (1, 0, "A"), (1, 1, "C"), (2, 0, "A"), (2, 1, "D"), (3, 0, "A"), (3, 1, "E"), (4, 0, "A")))
    found = graph.shortest_paths(edges, seeds)
    assert rows(found, "query_id", "hops") == [(1, 2), (2, 3)]
    path = found.where("query_id = 1").first()["path"]
    assert [tuple(e) for e in path] == [("A", "R1", "B"), ("B", "R1", "C")]


def test_paths_plan_grows_with_the_hops_only(spark, edges):
    seeds = graph.seeds(graph.vertices(edges), asked(spark, (1, 0, "A"), (1, 1, "C")))
    joins = [graph.shortest_paths(edges, seeds, hops)._jdf.queryExecution().optimizedPlan().toString().count("Join ") for hops in (2, 3, 4)]
    assert all(n <= hops for n, hops in zip(joins, (2, 3, 4), strict=True))


def test_k_hop(spark, edges):
    seeds = graph.seeds(graph.vertices(edges), asked(spark, (1, 0, "A")))
    assert rows(graph.k_hop_edges(edges, seeds), "src", "rel", "dst") == [("A", "R1", "B"), ("A", "R2", "B"), ("B", "R1", "C")]


def test_empty_keyword_matches_all(spark, edges):
    questions = spark.createDataFrame([(1, ["", "A"])], "id long, k array<string>")
    assert graph.seeds(graph.vertices(edges), graph.keyword_rows(questions, "id", F.col("k"))).count() == 7
    assert graph.seeds(graph.vertices(edges), graph.keyword_rows(questions, "id", F.col("k"), drop_empty=True)).count() == 1


def test_many_keywords_join_by_substring(spark, monkeypatch):
    nodes = spark.createDataFrame([("alpha beta",), ("beta",), ("aa",)], "id string")
    words = asked(spark, (1, 0, "BETA"), (1, 1, "A"), (2, 0, "PHA B"), (2, 1, "ZZ"), (3, 0, ""))
    want = rows(graph.seeds(nodes, words), "query_id", "pos", "id")
    monkeypatch.setattr(graph, "KEYWORDS_AT_ONCE", 2)
    assert rows(graph.seeds(nodes, words), "query_id", "pos", "id") == want


def test_upsert_is_idempotent_and_clears(spark):
    schema = "src string, rel string, dst string, description string, seq int"
    batch = spark.createDataFrame([("A", "R", "B", "first", 1), ("A", "R", "B", None, 2), ("A", "S", "B", "x", 3)], schema)
    once = graph.upsert_edges(batch.limit(0), batch, F.col("seq"))
    twice = graph.upsert_edges(once, batch, F.col("seq"))
    assert rows(once.select("rel", F.coalesce("description", F.lit("-")).alias("d")), "rel", "d") == [("R", "-"), ("S", "x")]
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ABCDEFG"), st.sampled_from("RS"), st.sampled_from("ABCDEFG")), max_size=12, unique=True))
def test_against_walks(spark, triples):
    edges = spark.createDataFrame(triples, "src string, rel string, dst string")
    und = [(s, d, (s, r, d)) for s, r, d in triples] + [(d, s, (s, r, d)) for s, r, d in triples if s != d]
    nodes = {x for s, _, d in triples for x in (s, d)}
    best = {}
    for o in nodes:
        front = {o: []}
        seen = {o}
        for _ in range(3):
            step = {}
            for (n, p), (a, b, e) in product(front.items(), und):
                if n == a and b not in seen and (b not in step or [*p, e] < step[b]):
                    step[b] = [*p, e]
            seen |= set(step)
            best |= {(o, v): p for v, p in step.items()}
            front = step
    words = [(1, 0, "A"), (1, 1, "B"), (2, 0, "C"), (2, 1, "A")]
    seeds = graph.seeds(graph.vertices(edges), asked(spark, *words))
    got = {(r["origin"], r["target"]): [tuple(e) for e in r["path"]] for r in graph.shortest_paths(edges, seeds).collect()}
    assert got == {k: p for k, p in best.items() if k in {("A", "B"), ("C", "A")}}
    hops = set()
    for a, b, e in und:
        if a == "A":
            hops.add(e)
            hops |= {f for c, _, f in und if c == b and f != e}
    got = {tuple(r) for r in graph.k_hop_edges(edges, seeds.where("query_id = 1 and pos = 0")).select("src", "rel", "dst").collect()}
    assert got == hops


def test_render_sizes_and_colours(spark):
    hub = [("H", f"R{k}", f"N{k}") for k in range(144)] + [("P", "R", "Q")]
    edges = spark.createDataFrame([(*e, "f", "1") for e in hub], "src string, rel string, dst string, source string, page string")
    lit = edges.where("src = 'P'")
    nodes = {r["id"]: r for r in viz.nodes(edges, viz.highlight_nodes(lit)).collect()}
    assert nodes["H"]["size"] == 45.0 and nodes["N0"]["size"] == 17.5 and nodes["P"]["size"] == 28.0
    assert nodes["P"]["color"] == viz.LIT and nodes["H"]["color"] == viz.DIM
    plain = {r["color"] for r in viz.edges(edges, viz.highlight_edges(lit.limit(0))).collect()}
    assert plain == {viz.PLAIN}
    assert "<td>P</td>" in viz.page(viz.nodes(edges, lit.select(F.col("src").alias("id"))), viz.edges(edges, lit))
