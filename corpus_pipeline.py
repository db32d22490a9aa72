"""A corpus pipeline over ``documents``: quality, near duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, decontam, quality, simhash, substring
from graphloom.llm.common import materialise, table
from graphloom.llm.queries import vocabulary_path


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: SimHash candidates, confirmed by a Jaccard similarity of the sets
    of five-word shingles of 0.8 or more."""
    return simhash.keep_one_alike(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that an earlier document holds, too; n_chars follows the text."""
    out = substring.remove_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that leak benchmark items."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether decoding gives the text back."""
    out = bpe.round_trip(docs, vocabulary_path())
    ids, text = F.sha2("ids", 256), F.sha2(F.col("text").cast("binary"), 256)
    return out.select(F.col("id").alias("doc_id"), (F.length("ids") / 4).cast("long").alias("n_tokens"), ids.alias("ids_sha256"), text.alias("decoded_sha256"))


STAGES = [
    ("quality", good_documents),
    ("near duplicates", one_of_each_group),
    ("repeated passages", without_repeats),
    ("benchmark leaks", without_leaks),
    ("tokens", tokens),
]
#: No stage can be stated in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{k}")
    return docs
