import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from graphloom.llm import queries, sharding
from graphloom.llm.common import table


def held(rows, shards):
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_query(spark, sf):
    rows = queries.op7_sharding(spark, sf).collect()
    held(rows, 8)
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    assert sorted(map(str, rows)) == sorted(map(str, queries.op7_sharding(spark, sf).collect()))


def test_against_brute_force(spark, sf):
    """The same law, sorted in one place."""
    docs = table(spark, sf, "documents").select("doc_id", "source")
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.interleave(docs, F.col("source"), F.col("doc_id"), 8).collect()}
    keyed = docs.select("doc_id", "source", F.xxhash64(F.lit(7), F.col("doc_id").cast("string")).alias("h"), F.xxhash64(F.lit(7), F.concat(F.lit("="), "source")).alias("u")).collect()
    unsigned = lambda x: x & (2**64 - 1)
    own = defaultdict(list)
    for r in sorted(keyed, key=lambda r: (unsigned(r["h"]) >> 1, r["h"])):
        own[r["source"]].append(r)
    order = sorted(((k + ((unsigned(r["u"]) >> 11) + 0.5) / (1 << 53)) / len(v), r["h"], s, r["doc_id"]) for s, v in own.items() for k, r in enumerate(v))
    n, seen = len(order), Counter()
    placed = {}
    for k, (*_, i) in enumerate(order):
        shard = k * 8 // n
        placed[i] = shard, seen[shard]
        seen[shard] += 1
    assert {i: s for i, (s, _) in got.items()} == {i: s for i, (s, _) in placed.items()}


def test_mixture(spark):
    rows = spark.range(8000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("source"))
    out = sharding.interleave(rows, F.col("source"), F.col("id"), 8).groupBy("source", "shard").count().collect()
    totals = Counter()
    for r in out:
        totals[r["source"]] += r["count"]
    assert all(abs(r["count"] - totals[r["source"]] / 8) <= 3 for r in out)


def test_odd_rows(spark, odd, none):
    out = sharding.interleave(odd, F.col("source"), F.col("doc_id"), 5)
    assert sorted(out.columns) == sorted(odd.columns)
    out = out.collect()
    assert len(out) == odd.count()
    held(out, 5)
    assert sharding.interleave(none, F.col("source"), F.col("doc_id"), 5).count() == 0


def test_bound_with_many_sources(spark):
    """The bound of the docstring, and about its root in practice."""
    n, sources = 20_000, 2001
    rows = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % (2 * sources - 3)).cast("string"))).alias("source"))
    out = sharding.interleave(rows, F.col("source"), F.col("id"), 8).where("source = 'hot'").groupBy("shard").count().collect()
    many = rows.select("source").distinct().count()
    worst = max(abs(r["count"] - n / 16) for r in out)
    assert len(out) == 8 and worst <= 2 + 2 * (n / 2) * many / n and worst <= 2 + 2 * many**0.5
