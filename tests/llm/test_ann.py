import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import ann, queries
from graphloom.llm.common import table


def brute(rows, k=20):
    """Exact answer of the contract: rows are (id, vector)."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % 20 == 0:
            best = sorted((-(q * x).sum(), j) for j, x in ok if j != i)[:k]
            out[i] = [(j, -s) for s, j in best]
    return out


def test_recall(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf, "embeddings").collect()]
    want, got = brute(rows), {}
    for r in queries.op10_ann(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = sum(len({j for j, _ in want[q]} & {j for _, j, _ in got[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * sum(map(len, want.values()))
    vectors = {i: np.array(v, float) for i, v in rows}
    for q, found in got.items():
        found.sort()
        assert [r for r, *_ in found] == list(range(1, len(want[q]) + 1))
        assert [(-s, j) for _, j, s in found] == sorted((-s, j) for _, j, s in found)
        assert all(abs(s - vectors[q] @ vectors[j]) < 1e-12 for _, j, s in found)


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 0.5, 0.0]) for i in range(60)] + [(100 + i, rng.standard_normal(3).tolist()) for i in range(30)]
    rows += [(200, None), (220, []), (240, [0.0, 0.0, 0.0]), (260, [1.0, None, 2.0]), (280, [float("nan"), 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0]), (320, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    rows += rows[:1]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    usable = [(i, [float(np.float32(x)) for x in v]) for i, v in dict(rows[:90]).items()]
    got = {}
    for r in ann.search(df, lambda i: i % 20 == 0, 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    want = brute(usable)
    assert {q: [j for _, j, _ in sorted(v)] for q, v in got.items()} == {q: [j for j, _ in v] for q, v in want.items()}


def test_parts_grow_and_clashing_columns(spark, monkeypatch):
    """More parts for a larger table, and the same answers of good recall; columns with the names used inside are not read."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((20, 16))
    rows = [(i, (centres[i % 20] + 0.4 * rng.standard_normal(16)).tolist()) for i in range(1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for c in ("id", "vec", "rep", "part", "query", "score", "rank", "block"):
        df = df.withColumn(c, F.lit("clash"))
    want = brute(rows)
    seen = []
    fit = ann.fit
    monkeypatch.setattr(ann, "fit", lambda x, parts, *rest: seen.append(parts) or fit(x, parts, *rest))
    for share, parts in ((4096, 32), (20, 64)):
        monkeypatch.setattr(ann, "SHARE", share)
        got = {}
        for r in ann.search(df, lambda i: i % 20 == 0, 20).collect():
            got.setdefault(r["query_id"], set()).add(r["id"])
        assert seen[-1] == parts and set(got) == set(want)
        assert sum(len(got[q] & {j for j, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)


def test_fewer_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [3.0])], "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in ann.search(df, lambda i: i % 20 == 0).collect())
    assert got == [(0, 1, 20, 3.0), (0, 2, 1, 2.0), (20, 1, 1, 6.0), (20, 2, 0, 3.0)]
    assert ann.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


@pytest.mark.parametrize("parts", [4, 16])
def test_parts_are_balanced_and_cut_few_edges(parts):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((parts, 8)) * 4
    x = np.concatenate([c + rng.standard_normal((50, 8)) for c in centres])
    graph = ann.neighbour_graph(x, 10)
    part = ann.balanced_parts(x, graph, parts, 1)
    sizes = np.bincount(part, minlength=parts)
    assert sizes.max() <= math.ceil(1.1 * len(x) / parts)
    cut = (part[graph] != part[:, None]).mean()
    assert cut < 0.7 * (1 - 1 / parts)


def test_router_reaches_its_target():
    rng = np.random.default_rng(4)
    x = np.concatenate([c + 0.3 * rng.standard_normal((200, 16)) for c in rng.standard_normal((16, 16))])
    router = ann.fit(x, 16, 10)
    assert router.probes < 16
    home, graph = router.order(x, 1)[:, 0], ann.neighbour_graph(x, 10)
    near = router.order(x, router.probes)
    assert (home[graph][:, :, None] == near[:, None, :]).any(2).mean() > 0.9
