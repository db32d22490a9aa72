"""Approximate nearest neighbours by learned partitions.

Fit (on a bounded sample of distinct vectors, SAMPLE or more for more parts): build the sample's neighbour graph, cut it into balanced parts
with few cut edges, and train a small classifier that predicts from a vector the parts of its neighbours. Index: every
vector goes to its most probable part. Search: a query goes to its most probable parts, as many as a validation
on the sample needs for the target recall, and all vectors there are reranked by the exact inner product.

Equal vectors are one class with its smallest ids: k + 1 of them are all that a result can show, which is exact, so
a vector that a third of the rows share costs no more than another. Parts are split into blocks of BLOCK vectors
and BLOCK queries, so the memory of a task is bounded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialise, slices
from graphloom.llm.common import parts as shuffle_parts

SAMPLE = 8192  # vectors to fit on, and 64 a part beyond 128 parts: 32,768 at most
PARTS = 32  # at least; a power of two
MOST = 512  # parts at most
SHARE = 4096  # vectors of a part, about: parts grow with the table up to MOST
BLOCK = 8192
TARGET = 0.94


# --- fit ---


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """(n, k) numbers of the rows with the largest inner product with each row, itself left out."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int, slack: float = 0.1, sweeps: int = 12) -> np.ndarray:
    """A part (0 to parts - 1) for each row, none larger than (1 + slack) n / parts: halving along principal directions,
    then moves of the rows with most neighbours elsewhere, best gains first, while there is room."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(x), np.int64)
    count = 1
    while count < parts:
        for p in range(count):
            own = np.flatnonzero(part == p)
            if not len(own):
                continue
            centred = x[own] - x[own].mean(0)
            v = rng.standard_normal(x.shape[1])
            for _ in range(8):
                v = centred.T @ (centred @ v)
                v /= np.linalg.norm(v) or 1.0
            order = np.argsort(centred @ v, kind="stable")
            part[own[order[len(own) // 2 :]]] += count
        count *= 2
    room = int(np.ceil((1 + slack) * len(x) / parts))
    sizes = np.bincount(part, minlength=parts)
    u = np.repeat(np.arange(len(x)), graph.shape[1])
    ends, starts = np.concatenate([u, graph.ravel()]), np.concatenate([graph.ravel(), u])
    for _ in range(sweeps):
        links = np.bincount(ends * parts + part[starts], minlength=len(x) * parts).reshape(-1, parts)
        best = links.argmax(1)
        gain = links[np.arange(len(x)), best] - links[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            if sizes[best[i]] < room:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """One hidden layer and a softmax over parts; probes is how many parts a query visits."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int = 1

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def order(self, x: np.ndarray, most: int) -> np.ndarray:
        return np.argsort(-self.scores(x), axis=1, kind="stable")[:, :most]


def train(x: np.ndarray, target: np.ndarray, seed: int, hidden: int = 256, epochs: int = 40, rate: float = 3e-3) -> Router:
    """Adam on the cross entropy with the parts' shares among each row's neighbours."""
    rng = np.random.default_rng(seed)
    d, p = x.shape[1], target.shape[1]
    w = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, p)) * np.sqrt(1 / hidden), np.zeros(p)]
    m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) * np.sqrt(d)
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 256):
            i = order[at : at + 256]
            h = np.maximum(x[i] @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            q = np.exp(z - z.max(1, keepdims=True))
            g = (q / q.sum(1, keepdims=True) - target[i]) / len(i)
            back = (g @ w[2].T) * (h > 0)
            t += 1
            for k, grad in enumerate((x[i].T @ back, back.sum(0), h.T @ g, g.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                step = rate * (1 - epoch / epochs)
                w[k] = w[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return Router(w[0] * np.sqrt(d), *w[1:])


def fit(x: np.ndarray, parts: int, k: int = 20, seed: int = 11, target: float = TARGET) -> Router:
    """A router over ``parts`` (a power of two) from distinct vectors. probes: the fewest parts that hold ``target`` of
    the k nearest of 1,024 of them. From fewer than 8 vectors a part there is nothing to learn how many to visit: fewer
    parts are made then, and all of them visited."""
    few = len(x) < 8 * parts
    if few:
        parts = 1 << max(0, (len(x) // 8).bit_length() - 1)
    if parts == 1 or len(x) < 3:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))
    graph = neighbour_graph(x, max(k, 10))
    part = balanced_parts(x, graph, parts, seed)
    share = np.bincount(np.repeat(np.arange(len(x)), graph.shape[1]) * parts + part[graph].ravel(), minlength=len(x) * parts).reshape(-1, parts)
    share = share / share.sum(1, keepdims=True)
    held = np.arange(len(x)) % 8 == 0  # held out of training, for the validation
    router = train(x[~held], share[~held], seed)
    asked = np.flatnonzero(held)[:1024]
    home = router.order(x, 1)[:, 0]
    rank = np.argsort(router.order(x[asked], parts), axis=1)  # rank[i, p]: place of part p for query i
    place = np.take_along_axis(rank, home[graph[asked][:, :]], axis=1)
    recall = np.array([(place < n).mean() for n in range(1, parts + 1)])
    router.probes = parts if few else min(parts, int(np.searchsorted(recall, target) + 1))
    return router


# --- search ---


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part: an id, and a vector without null or non-finite components, not all zero, of
    the length that most have. Repeated rows count once."""
    vec = F.col(vec_col)
    sound = lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))  # noqa: E731  NaN is larger than infinity
    rows = vectors.select(F.col(id_col).alias("id"), vec.alias("vec")).where("id is not null and vec is not null and size(vec) > 0")
    rows = rows.where(F.forall("vec", sound) & F.exists("vec", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vec") == (sizes[0]["n"] if sizes else 0)).distinct()


def _matrix(column) -> np.ndarray:
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def search(vectors: DataFrame, asked, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", target: float = TARGET, seed: int = 11, parts: int | None = None) -> DataFrame:
    """(query_id, rank, id, score): for each usable row whose id satisfies ``asked(id)`` its k nearest others found, by
    inner product in double precision, largest first, ties to the smaller id; all others, if fewer than k. parts: a power of
    two; None: one of about SHARE vectors each, PARTS at least and MOST at most.

    Null ids, and vectors that are null, zero, of another length or hold null or non-finite components, take no
    part; an empty table gives an empty result. An id with several vectors is several candidates with that id.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors, id_col, vec_col), "ann-rows")
    kind, inner = rows.schema["id"].dataType.simpleString(), rows.schema["vec"].dataType.simpleString()
    own = Window.partitionBy("vec").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    members = rows.select("id", "vec", F.row_number().over(own).alias("nth"), F.first("id").over(own).alias("rep")).where(F.col("nth") <= k + 1)
    members = materialise(members.select("id", "rep"), "ann-members")
    classes = rows.groupBy("vec").agg(F.min("id").alias("rep"), F.bool_or(asked(F.col("id"))).alias("asked"))
    classes = materialise(classes, "ann-classes")
    n = classes.count()
    parts = parts or min(MOST, max(PARTS, 1 << max(0, (n // SHARE - 1)).bit_length()))
    sample = classes.select("rep", "vec").orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(max(SAMPLE, 64 * parts)).toArrow()
    router = fit(_matrix(sample.column("vec")), parts, k, seed, target) if n else Router(np.zeros((1, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1))

    def placed(most: int):
        def run(batches):
            import pyarrow as pa

            for b in slices(batches, 8192):
                if b.num_rows:
                    order = router.order(_matrix(b.column(1)), most)
                    at = pa.array(np.repeat(np.arange(b.num_rows), order.shape[1]))
                    yield pa.RecordBatch.from_arrays([pa.array(order.ravel().astype(np.int32)), b.column(0).take(at), b.column(1).take(at)], ["part", "rep", "vec"])

        return run

    fields = f"part int, rep {kind}, vec {inner}"
    base = materialise(classes.select("rep", "vec").mapInArrow(placed(1), fields), "ann-base")
    queries = materialise(classes.where("asked").select("rep", "vec").mapInArrow(placed(router.probes), fields), "ann-queries")

    def blocks(df: DataFrame) -> list[int]:
        sizes = {r["part"]: r["count"] for r in df.groupBy("part").count().collect()}
        return [max(1, -(-sizes.get(p, 0) // BLOCK)) for p in range(max(parts, 1))]

    in_base, in_queries = (F.lit(x).cast("array<int>") for x in (blocks(base), blocks(queries)))
    own_block = lambda sizes: F.pmod(F.xxhash64("rep"), F.get(sizes, F.col("part"))).cast("int")
    every = lambda sizes: F.explode(F.sequence(F.lit(0), F.get(sizes, F.col("part")) - 1))
    left = base.select("*", own_block(in_base).alias("block"), every(in_queries).alias("qblock"))
    right = queries.select("*", own_block(in_queries).alias("qblock"), every(in_base).alias("block"))

    def rerank(own, questions):
        import pyarrow as pa

        ids, q_ids, out = own.column("rep").combine_chunks(), questions.column("rep").combine_chunks(), []
        x, q = _matrix(own.column("vec")), _matrix(questions.column("vec"))
        for at in range(0, len(q) if len(x) else 0, 1024):
            part = q[at : at + 1024]
            s = part @ x.T
            least = np.partition(s, -(k + 1), axis=1)[:, -(k + 1)] if s.shape[1] > k + 1 else s.min(1)
            # what rounding can move, relative to the vectors' lengths
            margin = 1e-12 * np.linalg.norm(part, axis=1) * np.linalg.norm(x, axis=1).max()
            i, j = np.nonzero(s >= (least - margin)[:, None])
            # one order of summation for every pair, so equal vectors score equally
            exact = np.concatenate([(part[i[c : c + 65_536]] * x[j[c : c + 65_536]]).sum(1) for c in range(0, len(i), 65_536)] or [np.zeros(0)])
            out.append(pa.table({"query": q_ids.take(pa.array(i + at)), "rep": ids.take(pa.array(j)), "score": exact}))
        return pa.concat_tables(out) if out else pa.table({"query": q_ids.slice(0, 0), "rep": ids.slice(0, 0), "score": np.zeros(0)})

    tasks = shuffle_parts(spark)
    key = ["part", "block", "qblock"]
    pairs = left.repartition(tasks, *key).groupBy(*key).cogroup(right.repartition(tasks, *key).groupBy(*key)).applyInArrow(rerank, f"query {kind}, rep {kind}, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    near = pairs.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).drop("nth")
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    near = near.join(members, "rep").withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= k + 1).select("query", "id", "score")
    asking = rows.where(asked(F.col("id"))).join(classes.select("vec", "rep"), "vec").select(F.col("id").alias("query_id"), F.col("rep").alias("query")).distinct()
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = asking.join(near, "query").where("query_id <> id").withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "id", "score")
