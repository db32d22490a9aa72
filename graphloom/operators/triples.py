"""Triples: offline extraction, JSON replies, validation, normalisation, quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.functions import text as fn


def extract_sentences(docs: DataFrame, id_col: str, text: Column, carry: tuple[Column, ...] = ()) -> DataFrame:
    """Offline default of the extractor: of each sentence (cut at ". ") with three words or more, the first three are
    source, relation and target. (id_col, item, source, relation, target, description, and the columns ``carry``)."""
    rows = docs.select(id_col, F.struct(F.lit(None).alias("__none"), *carry).alias("carry"), F.posexplode(F.split(fn.clean(text), r"\. ")).alias("item", "sentence"))
    words = F.split("sentence", " ")
    rows = rows.withColumn("w", words).where(F.size("w") >= 3)
    return rows.select(id_col, "item", F.col("w")[0].alias("source"), F.col("w")[1].alias("relation"), F.col("w")[2].alias("target"), F.col("sentence").alias("description"), "carry.*").drop("__none")


def parse_replies(replies: DataFrame, id_col: str, reply: Column) -> DataFrame:
    """Rows of the extractor's JSON replies; a malformed reply counts as no triples. Missing fields are null."""
    rows = replies.select(id_col, F.posexplode(F.from_json(reply, schemas.TRIPLES).getField("triples")).alias("item", "t"))
    return rows.select(id_col, "item", "t.source", "t.relation", "t.target", "t.description")


def is_usable(source: str = "source", target: str = "target") -> Column:
    return (F.coalesce(source, F.lit("")) != "") & (F.coalesce(target, F.lit("")) != "") & fn.valid_entity(F.col(source)) & fn.valid_entity(F.col(target))


def normalise(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, quarantine): usable triples as (src, rel, dst, description and all other columns), and the others."""
    ok = is_usable()
    rest = [c for c in triples.columns if c not in ("source", "relation", "target")]
    edges = triples.where(ok).select(fn.entity(F.col("source")).alias("src"), fn.relation(F.col("relation")).alias("rel"), fn.entity(F.col("target")).alias("dst"), *rest)
    return edges, triples.where(~ok)
