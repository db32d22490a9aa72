"""Comparative experiments: resume, two retrieval arms, offline rubric, long-form results, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as fn

METRICS = ("faithfulness", "relevance", "precision")
# The metrics' names in stored records.
SCORES = ("faithfulness_score", "relevance_score", "context_precision_score")
# What the arms answer when they found nothing.
NO_DOCUMENTS = "No relevant documents found."
NO_CONTEXT = "No relevant graph context found."


def numbered_pending(questions: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Questions not in ``done``, with their 1-based place in the whole set, done ones included."""
    placed = questions.withColumn("run_no", F.row_number().over(Window.orderBy(key)))
    return placed.join(done.select(key).distinct(), key, "left_anti")


def pending(questions: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Questions not in ``done``, with their 1-based place among those pending. A question list is small: the window
    over it is the one place where rows meet in one task."""
    rest = questions.join(done.select(key).distinct(), key, "left_anti")
    return rest.withColumn("run_no", F.row_number().over(Window.orderBy(key)))


def rubric(question: Column, intent: Column, context: Column, answer: Column) -> dict[str, Column]:
    """Offline judge: 1 to 5 by word overlap (answer in context; answer in question and intent; context in question)."""
    grade = lambda x: (1 + F.floor(4 * x)).cast("int")
    asked = F.concat_ws(" ", question, intent)
    return {"faithfulness": grade(fn.overlap(answer, context)), "relevance": grade(fn.overlap(answer, asked)), "precision": grade(fn.overlap(context, question))}


def evaluate(answers: DataFrame) -> DataFrame:
    """answers(query_id, arch, question, intent, context, answer) with a column for each metric."""
    scores = rubric(F.col("question"), F.col("intent"), F.col("context"), F.col("answer"))
    return answers.withColumns(scores)


def nested(results: DataFrame) -> DataFrame:
    """Long-form results as one record per question with a struct for each arm."""
    made = F.struct("answer", F.struct(*METRICS).alias("scores"))
    arm = lambda name: F.max(F.when(F.col("arch") == name, made)).alias(name)
    return results.groupBy("query_id", "question").agg(arm("baseline_vector_rag"), arm("proposed_graph_rag"))


def records(results: DataFrame, by: str = "query_id") -> DataFrame:
    """Long-form results(by, category, question, arch, answer, metrics, and error if known) as records of schemas.RESULTS."""
    note = F.col("error") if "error" in results.columns else F.lit(None)
    scores = [F.col(m).cast("int").alias(s) for m, s in zip(METRICS, SCORES, strict=True)]
    made = F.struct("answer", F.struct(*scores, F.lit(None).cast("string").alias("academic_justification"), note.cast("string").alias("error")).alias("scores"))
    arm = lambda name: F.max(F.when(F.col("arch") == name, made)).alias(name)
    return results.groupBy(F.col(by).cast("string").alias("id"), "category", "question").agg(arm("baseline_vector_rag"), arm("proposed_graph_rag"))


def report(results: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Mean of each metric per group, a missing score counting as 0, and the number of rows."""
    means = [F.coalesce(F.avg(F.coalesce(F.col(m), F.lit(0))), F.lit(0.0)).alias(m) for m in metrics]
    return results.groupBy(*by).agg(*means, F.count(F.lit(1)).alias("n"))


def console_rows(summary: DataFrame, name: str = "arch") -> DataFrame:
    """One centred line per architecture."""
    cell = lambda c, w: F.rpad(F.lpad(c, F.lit(w) - F.floor((F.lit(w) - F.length(c)) / 2).cast("int"), F.lit(" ")), F.lit(w), F.lit(" "))
    return summary.select(name, F.concat_ws(" | ", F.rpad(name, 24, " "), *(cell(fn.two_decimals(F.col(m)), 14) for m in METRICS)).alias("line"))


def latex_rows(summary: DataFrame, name: str = "arch") -> DataFrame:
    """One table row per architecture."""
    return summary.select(name, F.concat(F.replace(name, F.lit("_"), F.lit(r"\_")), *(F.concat(F.lit(" & "), fn.two_decimals(F.col(m))) for m in METRICS), F.lit(r" \\")).alias("line"))


def latex_table(summary: DataFrame) -> str:
    """The whole table; a summary has one row per architecture."""
    lines = [r[1] for r in latex_rows(summary).orderBy("arch").collect()]
    head = r"Architecture & Faithfulness & Answer relevance & Context precision \\"
    return "\n".join([r"\begin{tabular}{lccc}", r"\hline", head, r"\hline", *lines, r"\hline", r"\end{tabular}"])
