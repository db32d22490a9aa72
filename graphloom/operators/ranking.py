"""Ranking of evidence per question: lexical scores, top k, contexts, sentinels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as fn


def lexical_score(question: Column, candidate: Column) -> Column:
    """Distinct shared words over the root of the candidate's distinct words, to six digits."""
    own = fn.tokens(candidate)
    return F.round(F.size(F.array_intersect(fn.tokens(question), own)) / F.sqrt(F.greatest(F.size(own), F.lit(1))), 6)


def distinct_first(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """One row per key: the place of the first occurrence, the values of the last."""
    out = rows.groupBy(*keys).agg(F.min(order).alias(order), F.max_by(F.struct(*values), order).alias("__v"))
    return out.select(*keys, order, *(F.col("__v")[v].alias(v) for v in values))


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", tie: str = "triplet") -> DataFrame:
    """The k best rows of each query, with their rank; ties go by text."""
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def distinct_texts(candidates: DataFrame, values: tuple[str, ...] = ()) -> DataFrame:
    """One row per (query_id, triplet), with the smallest of the rows' ``values`` (the edge that a text is rendered from)."""
    if not values:
        return candidates.select("query_id", "triplet").distinct()
    rows = candidates.groupBy("query_id", "triplet").agg(F.min(F.struct(*values)).alias("__v"))
    return rows.select("query_id", "triplet", *(F.col("__v")[v].alias(v) for v in values))


def rerank(questions: DataFrame, candidates: DataFrame, k: int = 12, values: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, rank, triplet, score, *values) of the best candidates(query_id, triplet, *values) for questions(query_id,
    question)."""
    pairs = distinct_texts(candidates, values).join(questions.select("query_id", "question"), "query_id")
    scored = pairs.select("query_id", "triplet", lexical_score(F.col("question"), F.col("triplet")).alias("score"), *values)
    return top_k(scored, k).select("query_id", "rank", "triplet", "score", *values)


def context(ranked: DataFrame, text: str = "triplet", separator: str = "\n", by: str = "query_id") -> DataFrame:
    """One string per query: the ranked texts in order. A group has at most the top k rows."""
    rows = ranked.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", text))).alias("__r"))
    return rows.select(by, F.array_join(F.col("__r")[text], separator).alias("context"))


def two_contexts(ranked: DataFrame, text: str = "triplet", by: str = "query_id") -> DataFrame:
    """(by, context, judged): the ranked texts with rules between them for the prompt, and with line ends for the judge."""
    rows = ranked.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("rank", text))).alias("__r"))
    joined = lambda separator: F.array_join(F.col("__r")[text], separator)
    return rows.select(by, joined("\n---\n").alias("context"), joined("\n").alias("judged"))


def with_sentinel(questions: DataFrame, answers: DataFrame, column: str, sentinel: str, by: str = "query_id") -> DataFrame:
    """Every question with its answer, or the sentinel where it has none."""
    return questions.join(answers, by, "left").withColumn(column, F.coalesce(column, F.lit(sentinel)))
