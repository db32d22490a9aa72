"""Proportional stratified interleaving.

Rows are put in a seeded random order within each source; row k of a source of n rows has the fractional rank
(k + u) / n, u being a fraction that the source's name draws; sorting by it interleaves the sources in proportion, and cutting the sequence into equal pieces gives
shards that all have the mixture of the whole. (With one u for all, sources of like size would come in step, and a
cut through a step would favour some.)

Both rankings are counts of earlier buckets plus a rank within a bucket. A bucket of a source is a range of the
uniform shuffle key, one of the sequence is a range of the fractional rank; either holds about ROWS rows however
large its source is, so no source or shard is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import materialise

ROWS = 50_000  # rows of a bucket, about
LEAST = 64  # buckets at least


def _before(rows: DataFrame, by: list[str], bucket: str, total: str, start: str) -> DataFrame:
    """Counts of each bucket, rows in earlier buckets of the same stratum, and the stratum's total."""
    counts = rows.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = own.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*by, bucket, F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias(start), F.sum("__n").over(own).alias(total))


def interleave(rows: DataFrame, source: Column, key: Column, shards: int, seed: int = 7) -> DataFrame:
    """``rows`` with columns shard (0 to shards - 1) and slot (from 0, without gaps, in each shard).

    key: identifies a row; the shuffle order is that of a hash of it and the seed, ties follow the key and then every
    row that is equal is interchangeable. Shards' row counts differ by one at most. At any place of the sequence each
    source is within one row of its share of the place; a cut is by count, and its place is off by at most S / N (S
    sources, N rows), so of a source of n rows a shard has n / shards rows within 2 + 2 n S / N: two or three for few
    sources. The fractions drawn by the sources make it about the root of S instead of S. A null source is a source of
    its own; null keys and repeated rows are placed like any others; an empty table gives an empty result. Columns of
    ``rows`` called shard or slot are replaced; names starting with ``__`` are reserved.
    """
    base = rows.withColumns({"__source": F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null")), "__key": key})
    base = materialise(base.drop("shard", "slot").withColumn("__hash", F.xxhash64(F.lit(seed), F.col("__key").cast("string"))), "sharding")
    total = base.count()
    buckets = max(LEAST, total // ROWS)
    width = (1 << 63) // buckets + 1
    base = base.withColumn("__bucket", F.floor(F.shiftrightunsigned("__hash", 1) / F.lit(width)))
    others = [c for c in rows.columns if c not in ("shard", "slot")]
    within = Window.partitionBy("__source", "__bucket").orderBy("__hash", "__key", *others)
    ranked = base.withColumn("__rank", F.row_number().over(within) - 1)
    starts = _before(base, ["__source"], "__bucket", "__total", "__start")
    ranked = ranked.join(starts, ["__source", "__bucket"])
    drawn = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("__source")), 11) + 0.5) / float(1 << 53)
    ranked = ranked.withColumn("__place", (F.col("__start") + F.col("__rank") + drawn) / F.col("__total"))
    ranked = materialise(ranked.drop("__bucket", "__rank", "__start", "__total"), "sharding")
    ranked = ranked.withColumn("__cell", F.floor(F.col("__place") * buckets))
    cells = _before(ranked, [], "__cell", "__total", "__start")
    order = Window.partitionBy("__cell").orderBy("__place", "__hash", "__source", "__key", *others)
    placed = ranked.withColumn("__rank", F.row_number().over(order) - 1).join(cells, "__cell")
    at = (F.col("__start") + F.col("__rank")).cast("long")
    shard = F.expr(f"cast((__at * {shards}) div __total as int)")
    placed = placed.withColumn("__at", at).withColumn("shard", shard)
    first = F.expr(f"(shard * __total + {shards - 1}) div {shards}")
    return placed.withColumn("slot", (F.col("__at") - first).cast("long")).select(*others, "shard", "slot")
