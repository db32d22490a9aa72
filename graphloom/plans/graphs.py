"""Two graphs over the test tables: G1 from the star schema, G2 from the documents' sentences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import graph, triples
from graphloom.sources.tables import table
from graphloom.storage import stored


def g1(spark: SparkSession, d: str) -> DataFrame:
    """nation -IN_REGION-> region, brand -HAS_TYPE-> type, nation -SUPPLIES-> brand."""
    nation, part = table(spark, d, "nation"), table(spark, d, "part")
    up = lambda c: F.upper(c)
    regions = nation.join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    regions = regions.select(up("n_name").alias("src"), F.lit("IN_REGION").alias("rel"), up("r_name").alias("dst"))
    types = part.select(up("p_brand").alias("src"), F.lit("HAS_TYPE").alias("rel"), up("p_type").alias("dst"))
    lines = table(spark, d, "lineitem").where("l_quantity >= 50 and l_discount >= 0.09").select("l_suppkey", "l_partkey").distinct()
    sold = lines.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sold = sold.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
    supplies = sold.select(up("n_name").alias("src"), F.lit("SUPPLIES").alias("rel"), up("p_brand").alias("dst"))
    return regions.unionByName(types).unionByName(supplies).distinct()


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Raw triples with their place: seq orders the writes of the upsert."""
    rows = triples.extract_sentences(table(spark, d, "documents"), "doc_id", F.col("text"), (F.col("source").alias("file"),))
    return rows.select("doc_id", "item", "source", "relation", "target", "description", F.col("file"), fn.page_label(F.col("item")).alias("page"))


def g2_writes(spark: SparkSession, d: str) -> DataFrame:
    """Normalised triples that pass the validator, one row per write."""
    edges, _ = triples.normalise(sentences(spark, d))
    return edges.select("src", "rel", "dst", "description", F.col("file").alias("source"), "page", F.struct("doc_id", "item").alias("seq"))


def g2(spark: SparkSession, d: str, store: bool = False) -> DataFrame:
    """The edges of G2; ``store`` where they are used several times: the texts are then read once."""
    edges = g2_writes(spark, d).select("src", "rel", "dst").distinct()
    return stored(edges, "g2") if store else edges


#: Keyword lists over G1: (query_id, keywords).
ASKED = ((1, ("NATION_1", "EUROPE")), (2, ("BRAND#1", "ASIA")), (3, ("NATION_2", "AMERICA", "BRAND#5")), (4, ("MIDDLE EAST",)), (5, ("NO SUCH NAME", "ASIA")))


def asked(spark: SparkSession) -> DataFrame:
    rows = [(q, k, w) for q, words in ASKED for k, w in enumerate(words)]
    return spark.createDataFrame(rows, "query_id long, pos int, keyword string")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
