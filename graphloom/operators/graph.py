"""A property graph as vertices(id) and edges(src, rel, dst, ...): upsert, statistics, matching, traversal.

Questions are always many: (query_id, pos, keyword) rows go through each operator together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.storage import stored

KEY = ("src", "rel", "dst")
KEYWORDS_AT_ONCE = 256  # distinct keywords that each node is probed with at most


def collapse(edges: DataFrame, order: Column) -> DataFrame:
    """The last write of each (src, rel, dst) by ``order``; its nulls count too."""
    values = [c for c in edges.columns if c not in KEY]
    last = edges.groupBy(*KEY).agg(F.max_by(F.struct(*values), order).alias("__v"))
    return last.select(*KEY, *(F.col("__v")[c].alias(c) for c in values))


def upsert_edges(existing: DataFrame, batch: DataFrame, order: Column) -> DataFrame:
    """``existing`` merged with the last writes of ``batch``: a matched edge takes all the new values."""
    return merge_edges(existing, collapse(batch, order))


def merge_edges(existing: DataFrame, new: DataFrame) -> DataFrame:
    """As ``upsert_edges``, of edges that are unique by (src, rel, dst)."""
    values = [c for c in new.columns if c not in KEY]
    old = existing.select(*KEY, F.struct(*values).alias("__old"))
    new = new.select(*KEY, F.struct(*values).alias("__new"))
    merged = old.join(new, list(KEY), "full_outer").withColumn("__v", F.coalesce("__new", "__old"))
    return merged.select(*KEY, *(F.col("__v")[c].alias(c) for c in values))


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def stats(nodes: DataFrame, edges: DataFrame, true_stats: bool = False) -> DataFrame:
    """One row (nodes, relationships); without relationships both are 0 unless ``true_stats``."""
    n, m = nodes.agg(F.count(F.lit(1)).alias("n")), edges.agg(F.count(F.lit(1)).alias("m"))
    shown = F.col("n") if true_stats else F.when(F.col("m") == 0, F.lit(0)).otherwise(F.col("n"))
    return n.crossJoin(m).select(shown.cast("long").alias("nodes"), F.col("m").alias("relationships"))


def sample_edges(edges: DataFrame, limit: int = 400) -> DataFrame:
    """The first edges in canonical order."""
    return edges.orderBy(*KEY).limit(limit)


def degrees(edges: DataFrame) -> DataFrame:
    """Occurrences of each node as source and target; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge from either end: (a, b, src, rel, dst). A loop comes once."""
    forward = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *KEY)
    return forward.unionByName(edges.where("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), *KEY))


def keyword_rows(questions: DataFrame, id_col: str, keywords: Column, drop_empty: bool = False) -> DataFrame:
    rows = questions.select(F.col(id_col).alias("query_id"), F.posexplode(keywords).alias("pos", "keyword"))
    return rows.where("keyword <> ''") if drop_empty else rows


def seeds(nodes: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, pos, keyword, id): nodes whose upper-cased id contains the keyword; an empty keyword matches all.

    Up to KEYWORDS_AT_ONCE distinct keywords are broadcast and probed; beyond, ids are cut into all their
    substrings of the keywords' lengths and joined by equality.
    """
    distinct = keywords.select("keyword").distinct()
    named = nodes.select("id", F.upper("id").alias("__id"))
    if len(distinct.limit(KEYWORDS_AT_ONCE + 1).take(KEYWORDS_AT_ONCE + 1)) <= KEYWORDS_AT_ONCE:
        found = named.join(F.broadcast(distinct), F.contains("__id", "keyword")).select("keyword", "id")
    else:
        lengths = F.lit(sorted(r[0] for r in distinct.select(F.length("keyword")).distinct().collect()))
        starts = named.select("id", "__id", F.explode(lengths).alias("__n")).where("__n <= length(__id)")
        starts = starts.withColumn("__at", F.explode(F.expr("sequence(1, length(__id) - __n + 1)")))
        found = starts.select("id", F.expr("substring(__id, __at, __n)").alias("keyword")).distinct().join(distinct, "keyword")
    return keywords.join(found, "keyword").select("query_id", "pos", "keyword", "id")


def neighbours(edges: DataFrame, seeds: DataFrame, limit: int | None = 10, oriented: bool = False) -> DataFrame:
    """One-hop matches of each (query_id, keyword), at most ``limit`` in canonical order: (query_id, pos, keyword, src,
    rel, dst). The matched node is always the source, as the reference prints it; ``oriented`` keeps the stored
    direction instead."""
    hops = seeds.join(undirected(edges), F.col("id") == F.col("a"))
    if limit is not None:
        order = Window.partitionBy("query_id", "pos").orderBy("a", "rel", "b", "src")
        hops = hops.withColumn("__k", F.row_number().over(order)).where(f"__k <= {limit}")
    ends = ("src", "dst") if oriented else ("a", "b")
    return hops.select("query_id", "pos", "keyword", F.col(ends[0]).alias("src"), "rel", F.col(ends[1]).alias("dst"))


def k_hop_edges(edges: DataFrame, seeds: DataFrame, limit: int | None = None) -> DataFrame:
    """Distinct edges on undirected paths of one or two hops from a seed of each query: those at a seed or at a direct
    neighbour of one. ``limit``: the first in canonical order, per query."""
    both = undirected(edges)
    start = seeds.select("query_id", "id").distinct()
    near = start.join(both, F.col("id") == F.col("a")).select("query_id", F.col("b").alias("id"))
    reached = start.union(near).distinct()
    found = reached.join(both, F.col("id") == F.col("a")).select("query_id", *KEY).distinct()
    if limit is not None:
        order = Window.partitionBy("query_id").orderBy(*KEY)
        found = found.withColumn("__k", F.row_number().over(order)).where(f"__k <= {limit}").drop("__k")
    return found


def shortest_paths(edges: DataFrame, seeds: DataFrame, hops: int = 3) -> DataFrame:
    """(query_id, origin, target, hops, path): an undirected shortest path of at most ``hops`` edges from each seed of
    the first keyword to each other seed of the second. Of equally short ones the smallest by its edges' order;
    path is array<struct<src, rel, dst>>.

    Breadth first: each level keeps the smallest path of each (query, origin, node), and leaves out nodes reached
    before. Each level is stored, so the joins grow with the hops only, and no level is computed twice.
    """
    both = stored(undirected(edges).select("a", "b", F.struct(*KEY).alias("edge")), "paths-edges")
    seeds = stored(seeds.where("pos < 2").select("query_id", "pos", "id").distinct(), "paths-seeds")
    origins = seeds.where("pos = 0").select("query_id", F.col("id").alias("origin")).distinct()
    ends = seeds.where("pos = 1").select("query_id", F.col("id").alias("target")).distinct()
    origins = origins.join(ends.select("query_id").distinct(), "query_id", "left_semi")
    empty = F.array().cast("array<struct<src: string, rel: string, dst: string>>")
    front = origins.select("query_id", "origin", F.col("origin").alias("node"), empty.alias("path"))
    seen, levels = front.select("query_id", "origin", "node"), None
    for depth in range(1, hops + 1):
        step = front.join(both, F.col("node") == F.col("a")).select("query_id", "origin", F.col("b").alias("node"), F.concat("path", F.array("edge")).alias("path"))
        step = step.join(seen, ["query_id", "origin", "node"], "left_anti")
        front = stored(step.groupBy("query_id", "origin", "node").agg(F.min("path").alias("path")), "paths-level")
        level = front.withColumn("hops", F.lit(depth))
        levels = level if levels is None else levels.unionByName(level)
        seen = seen.unionByName(front.select("query_id", "origin", "node"))
    found = levels.withColumnRenamed("node", "target").join(ends, ["query_id", "target"], "left_semi")
    return found.where("origin <> target").select("query_id", "origin", "target", "hops", "path")


def candidates(paths: DataFrame, near: DataFrame) -> DataFrame:
    """Distinct (query_id, src, rel, dst) of the paths' edges and of the neighbours."""
    on_path = paths.select("query_id", F.explode("path").alias("e")).select("query_id", "e.*")
    return on_path.unionByName(near.select("query_id", *KEY)).distinct()
