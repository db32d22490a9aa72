"""Model boundaries. A backend takes an iterator of pandas frames and yields frames; a model is loaded once a task.

Each has an offline default that needs no model; a frame that fails is tried again row by row, and only the rows that fail get the failure value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom import schemas
from graphloom.functions import text as fn

from graphloom.operators import experiment, ranking

Model = Callable[[], Callable[[pd.DataFrame], pd.Series]]


def apply(rows: DataFrame, model: Model, output: str, kind: str, failure) -> DataFrame:
    """``rows`` with a column ``output`` from ``model()(frame)``; a row that fails gets ``failure``."""

    def alone(call, frame):
        for k in range(len(frame)):
            try:
                yield list(call(frame.iloc[k : k + 1].copy()))[0]
            except Exception as e:
                yield failure(e) if callable(failure) else failure

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = model()
        for frame in frames:
            try:
                made = list(call(frame.copy()))
            except Exception:
                made = list(alone(call, frame))
            yield frame.assign(**{output: pd.Series(made, frame.index, dtype=object if any(x is None for x in made) else None)})

    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField(output, T.DataType.fromDDL(kind))]))


@dataclass
class Backends:
    """None means the offline default, a Column expression."""

    extract: Model | None = None  # text -> JSON of triples; failure: no triples
    keywords: Model | None = None  # question -> comma list; failure: none, or the question's words
    score: Model | None = None  # question, triplet -> number
    answer: Model | None = None  # question, context -> text; failure: the error's text
    judge: Model | None = None  # question, intent, context, answer -> JSON of scores; failure: zeros
    chat: Model | None = None  # prompt (array of role and content), context -> text; failure: the error's text
    embed: Model | None = None  # text -> list of numbers; failure: null, which no search finds

    def with_keywords(self, questions: DataFrame, question: str = "question", engine: bool = False) -> DataFrame:
        """``questions`` with keywords. ``engine``: the reply's entities of any length, and none where the model fails; else those
        of more than two letters, and the question's own words where there is none."""
        if self.keywords is None:
            return questions.withColumn("keywords", fn.fallback_keywords(F.col(question)))
        said = apply(questions, self.keywords, "__reply", "string", None if engine else "")
        if engine:
            return said.withColumn("keywords", fn.engine_keywords(F.col("__reply"))).drop("__reply")
        return said.withColumn("keywords", fn.keywords_or_fallback(F.col("__reply"), F.col(question))).drop("__reply")

    def with_score(self, pairs: DataFrame) -> DataFrame:
        if self.score is None:
            return pairs.withColumn("score", ranking.lexical_score(F.col("question"), F.col("triplet")))
        return apply(pairs, self.score, "score", "double", 0.0)

    def with_answer(self, rows: DataFrame, default: Column) -> DataFrame:
        if self.answer is None:
            return rows.withColumn("answer", default)
        return apply(rows, self.answer, "answer", "string", lambda e: f"Error: {e}")

    def with_chat_answer(self, prompts: DataFrame) -> DataFrame:
        """chat.prompts with answer. Offline: the first three lines of the context."""
        if self.chat is None:
            return prompts.withColumn("answer", F.substring_index("context", "\n", 3))
        return apply(prompts, self.chat, "answer", "string", lambda e: f"Error: {e}")

    def with_embedding(self, rows: DataFrame, text: str) -> DataFrame:
        """``rows`` with embedding array<float>. Offline: words hashed to 64 places, of length one."""
        if self.embed is not None:
            made = apply(rows.withColumn("text", F.col(text)) if text != "text" else rows, self.embed, "embedding", "array<float>", None)
            return made if text == "text" else made.drop("text")
        places = F.transform(fn.tokens(F.coalesce(text, F.lit(""))), lambda t: F.pmod(F.xxhash64(t), F.lit(64)))
        counts = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double"))
        norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
        return rows.withColumn("embedding", F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0).cast("float")))

    def with_judgement(self, answers: DataFrame) -> DataFrame:
        """answers(question, intent, context, answer, ...) with the three metrics and error. A model's empty reply gives an
        error and null scores; a model's failure gives zeros."""
        if self.judge is None:
            return experiment.evaluate(answers).withColumn("error", F.lit(None).cast("string"))
        zero = '{"faithfulness_score": 0, "relevance_score": 0, "context_precision_score": 0}'
        said = apply(answers, self.judge, "__reply", "string", zero)
        parsed = said.withColumn("__s", F.from_json("__reply", T.DataType.fromDDL(schemas.SCORE)))
        empty = F.coalesce(F.trim("__reply"), F.lit("")) == ""
        names = zip(experiment.METRICS, experiment.SCORES, strict=True)
        parsed = parsed.withColumns({m: F.col("__s")[s] for m, s in names})
        return parsed.withColumn("error", F.when(empty, "empty reply").otherwise(F.col("__s.error"))).drop("__reply", "__s")

    def with_triples(self, chunks: DataFrame) -> DataFrame:
        if self.extract is None:
            raise ValueError("the offline default is triples.extract_sentences")
        return apply(chunks, self.extract, "reply", "string", '{"triples": []}')
