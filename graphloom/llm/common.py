"""Helpers shared by the training-data operators: shared storage, word hashing, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a folder of our own where it is unset
    (local mode, as in tests)."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return sc.getCheckpointDir().rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read it back. A lost executor loses nothing, and
    every later use sees the same rows."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


FEW = 200_000  # rows of ids and hashes that are broadcast at most: some 10 MB


def beside(df: DataFrame) -> DataFrame:
    """A stored table of short rows for a join with texts: broadcast if it has at most FEW rows, which are counted here; else
    the texts are shuffled to it."""
    return F.broadcast(df) if df.count() <= FEW else df.hint("merge")


def parts(spark: SparkSession, least: int = 12) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(column) -> list[bytes]:
    """UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def slices(batches, rows: int = 1024):
    """Arrow batches cut to at most ``rows`` rows, so that what a worker makes of one stays small. After the last, memory
    that the worker no longer uses goes back to the system."""
    import ctypes

    import pyarrow as pa

    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


BATCH = 1 << 20  # bytes of text handled at a time


def pieces(texts: list[bytes]):
    """(from, to) of runs of texts of about BATCH bytes."""
    lo = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BATCH or k == len(texts) - 1:
            yield lo, k + 1
            lo, size = k + 1, 0


# --- vectorised words -------------------------------------------------------------------------------------------

#: 1 for bytes that belong to a word: ASCII letters and digits, and all of UTF-8 beyond ASCII.
WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD[_a:_b] = True
#: A-Z to a-z.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes in a uint8 array."""
    edge = np.diff(WORD[data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


_POWER: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's folded bytes: sums over the first and further 8-byte groups, mixed.

    Words of up to 8 bytes take one gather; longer ones fold in further groups, as many as the longest word has.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = FOLD[data]
    grams = np.ndarray(len(data) + 1, np.uint64, padded.tobytes(), 0, (1,))
    length = ends - starts
    out = length.astype(np.uint64)
    live, at, left = np.arange(len(starts)), starts, length
    while len(live):
        shift = (8 * (8 - np.minimum(left, 8))).astype(np.uint64)
        group = grams[at] << shift
        h = (out[live] ^ group) * _MULT
        out[live] = h ^ (h >> np.uint64(29))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


# --- connected components ---------------------------------------------------------------------------------------


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the same for all nodes of a component.

    Each round every node points to its smallest neighbour (or itself), pointers are doubled until they end at nodes that
    point to themselves, edges are rewritten to these and made distinct. A round leaves at most half of the nodes, and
    it stops when no edge is left. Only aggregates with map-side combining and equi joins are used (skewed ones are
    split by AQE); nothing is collected. Null ends are dropped.
    """
    live = materialise(edges.where("a <> b").select("a", "b").distinct(), label)
    roots = materialise(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), label)
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        point = materialise(point, label)
        moved = True
        while moved:
            onward = point.select(F.col("a").alias("p"), F.col("p").alias("q"))
            step = materialise(point.join(onward, "p").select("a", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), label)
            point, moved = step.select("a", "p"), not step.where("moved").isEmpty()
        on_b = point.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        live = live.join(point, "a").join(on_b, "b").where("p <> pb")
        live = materialise(live.select(F.least("p", "pb").alias("a"), F.greatest("p", "pb").alias("b")).distinct(), label)
        ends = point.select(F.col("a").alias("root"), F.col("p").alias("to"))
        roots = materialise(roots.join(ends, "root", "left").select("node", F.coalesce("to", "root").alias("root")), label)
    return roots
