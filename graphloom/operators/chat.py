"""Chat sessions: the window of last messages, refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as fn


def window(messages: DataFrame, last: int = 4, by: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last messages of each conversation (a group limit keeps ``last`` rows a task before the shuffle)."""
    newest = Window.partitionBy(by).orderBy(F.desc(order))
    return messages.withColumn("__k", F.row_number().over(newest)).where(F.col("__k") <= last).drop("__k")


def windows(messages: DataFrame, last: int = 4, by: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """For each message the window of the last ones up to it, as one text: what a reply at that point would see."""
    upto = Window.partitionBy(by).orderBy(order).rowsBetween(1 - last, 0)
    line = F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce(text, F.lit("")))
    return messages.select(by, order, F.array_join(F.collect_list(line).over(upto), "\n").alias("window"))


# Fixed value: what stands before the evidence, if a caller has no prompt of their own.
SYSTEM = "Answer from the context only.\n{context}"


def prompts(messages: DataFrame, contexts: DataFrame, system: str = SYSTEM, last: int = 4, by: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(by, context, prompt): for each conversation the model's input as array<struct<role, content>>: the system prompt with
    the context of contexts(by, context), empty where there is none, and the last messages in order."""
    said = F.sort_array(F.collect_list(F.struct(order, F.coalesce("role", F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("content"))))
    rows = window(messages, last, by, order).groupBy(by).agg(said.alias("__m")).join(contexts.select(by, "context"), by, "left")
    rows = rows.withColumn("context", F.coalesce("context", F.lit("")))
    head, _, tail = system.partition("{context}")
    first = F.struct(F.lit("system").alias("role"), F.concat(F.lit(head), "context", F.lit(tail)).alias("content"))
    rest = F.transform("__m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.select(by, "context", F.concat(F.array(first), rest).alias("prompt"))


def settled(answers: DataFrame, answer: str = "answer", context: str = "context") -> DataFrame:
    """``answers`` with ``refused``; a refusal has no context."""
    refused = fn.is_refusal(F.col(answer))
    return answers.withColumns({"refused": refused, context: F.when(refused, F.lit("")).otherwise(F.col(context))})


def highlights(evidence: DataFrame, answers: DataFrame, by: str = "conv_id") -> DataFrame:
    """Rows of evidence(by, ...) whose answer in ``settled`` answers(by, refused) is no refusal: a refusal clears them."""
    return evidence.join(answers.where("refused").select(by).distinct(), by, "left_anti")


def refusals(messages: DataFrame, text: str = "text") -> DataFrame:
    return messages.where(fn.is_refusal(F.col(text)))
