"""Vector collection: exact nearest neighbours and idempotent inserts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

QUERIES_AT_ONCE = 4096  # query vectors that are broadcast, or in a block, at most
VECTORS_AT_ONCE = 65_536  # vectors in a block, about
ROWS_AT_ONCE = 1024  # vectors that a task compares with them at a time


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.round(((q - x) ** 2).sum(1), 6)
    return np.round(1 - (q * x).sum(1) / np.sqrt((q * q).sum(1) * (x * x).sum(1)), 6)


def _rough(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """All distances by a matrix product: off by rounding only."""
    if metric == "l2":
        return (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * (q @ x.T)
    return 1 - (q @ x.T) / np.sqrt((q * q).sum(1)[:, None] * (x * x).sum(1))


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, metric: str = "l2") -> DataFrame:
    """(query_id, rank, id, distance) for queries(query_id, query) over vectors(id, embedding): exact, distances ("l2",
    squared, or "cosine") to six digits, ties by id.

    Up to QUERIES_AT_ONCE queries are broadcast, and a task keeps k rows a query. Beyond, blocks of queries meet blocks of
    vectors in a task each, and nothing goes through the driver. Vectors that are null, of another length than the query,
    or hold null or non-finite components have no distance, nor have zero vectors a cosine.
    """
    spark = vectors.sparkSession
    sound = lambda c: F.col(c).isNotNull() & (F.size(c) > 0) & F.forall(c, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & (F.lit(metric == "l2") | F.exists(c, lambda x: x != 0))
    asked, base = queries.where(sound("query")).select("query_id", "query"), vectors.where(sound("embedding")).select("id", "embedding")
    schema = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {base.schema['id'].dataType.simpleString()}, distance double"
    n = asked.count()
    if n <= QUERIES_AT_ONCE:
        held = spark.sparkContext.broadcast(asked.toArrow())
        out = base.mapInArrow(lambda batches: _search(held.value, batches, k, metric), schema)
    else:
        blocks, of = -(-n // QUERIES_AT_ONCE), -(-base.count() // VECTORS_AT_ONCE)
        own = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
        every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(max(m, 1) - 1)))
        left = base.select(own("id", max(of, 1)).alias("v"), every(blocks).alias("q"), "id", "embedding").groupBy("v", "q")
        right = asked.select(every(of).alias("v"), own("query_id", blocks).alias("q"), "query_id", "query").groupBy("v", "q")

        def meet(own_vectors, own_queries):
            import pyarrow as pa

            batches = own_vectors.select(["id", "embedding"]).to_batches()
            names = ["query_id", "id", "distance"]
            found = list(_search(own_queries.select(["query_id", "query"]), batches, k, metric))
            none = pa.table([own_queries.column("query_id").slice(0, 0), own_vectors.column("id").slice(0, 0), pa.array([], pa.float64())], names)
            return pa.Table.from_batches(found).cast(none.schema) if found else none

        out = left.cogroup(right).applyInArrow(meet, schema)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")


def _search(asked, batches, k: int, metric: str):
    """Record batches (query_id, id, distance): of each query of the table asked(query_id, query) the k nearest in ``batches``
    (id, embedding)."""
    import pandas as pd
    import pyarrow as pa

    by_length: dict[int, list[int]] = {}
    for n, q in enumerate(asked.column("query").to_pylist()):
        by_length.setdefault(len(q), []).append(n)
    queries = {d: (asked.column("query_id").take(pa.array(rows)).combine_chunks(), _matrix(asked.column("query").take(pa.array(rows)))) for d, rows in by_length.items()}
    held: dict[int, pd.DataFrame] = {}
    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            part = b.slice(at, ROWS_AT_ONCE)
            ids, lengths = np.array(part.column(0).to_pylist(), object), np.array([len(v) for v in part.column(1).to_pylist()])
            for d, (_, q) in queries.items():
                rows = np.flatnonzero(lengths == d)
                if not len(rows):
                    continue
                x = _matrix(part.column(1).take(pa.array(rows)))
                rough = _rough(q, x, metric)
                least = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(x) > k else rough.max(1)
                # what rounding, and rounding to six digits, can move
                i, j = np.nonzero(rough <= (least + 2e-6 + 1e-9 * np.abs(least))[:, None])
                exact = np.concatenate([_exact(q[i[c : c + 65_536]], x[j[c : c + 65_536]], metric) for c in range(0, len(i), 65_536)])
                made = pd.DataFrame({"q": i, "distance": exact, "id": ids[rows[j]]})
                made = made if d not in held else pd.concat([held[d], made])
                held[d] = made.sort_values(["q", "distance", "id"]).groupby("q").head(k)
    for d, rows in held.items():
        names = queries[d][0].take(pa.array(rows["q"].to_numpy()))
        yield pa.RecordBatch.from_arrays([names, pa.array(rows["id"].tolist(), kind), pa.array(rows["distance"].to_numpy())], ["query_id", "id", "distance"])


def insert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``existing`` and those rows of ``new`` whose key it lacks; of repeated new keys one row is taken."""
    return existing.unionByName(new.dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(existing.columns))
