"""Render tables of the graph: highlight flags, sizes, colours, tooltips, and a plain HTML page."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators import graph

# Sizes and colours.
HIGHLIGHT_SIZE, BASE_SIZE, DEGREE_SIZE, LARGEST = 28.0, 15.0, 2.5, 45.0
LIT, DIM, PLAIN = "#FF4B4B", "#D3D3D3", "#4B8BFF"


def highlight_nodes(edges: DataFrame) -> DataFrame:
    return graph.vertices(edges)


def highlight_edges(edges: DataFrame) -> DataFrame:
    """Pairs of highlighted ends: the relation does not matter, the direction does."""
    return edges.select("src", "dst").distinct()


def _any(flags: DataFrame) -> DataFrame:
    return flags.agg((F.count(F.lit(1)) > 0).alias("__any"))


def _colour(lit: Column) -> Column:
    return F.when(lit, F.lit(LIT)).when(F.col("__any"), F.lit(DIM)).otherwise(F.lit(PLAIN))


def nodes(edges: DataFrame, lit_nodes: DataFrame) -> DataFrame:
    """(id, title, color, size): title names the first edge that touches the node; size is by degree unless lit."""
    first = edges.select(F.explode(F.array("src", "dst")).alias("id"), "src", "rel", "dst", "source", "page")
    first = first.groupBy("id").agg(F.count(F.lit(1)).alias("degree"), F.min_by(F.struct("source", "page"), F.struct("src", "rel", "dst")).alias("at"))
    lit = lit_nodes.select("id", F.lit(True).alias("__lit")).distinct()
    rows = first.join(lit, "id", "left").crossJoin(F.broadcast(_any(lit_nodes)))
    shown = F.coalesce("__lit", F.lit(False))
    size = F.when(shown, F.lit(HIGHLIGHT_SIZE)).otherwise(F.least(F.lit(LARGEST), BASE_SIZE + F.sqrt("degree") * DEGREE_SIZE))
    title = F.concat(F.col("id"), F.lit(" | "), F.coalesce(F.col("at.source"), F.lit("None")), F.lit(" p."), F.coalesce(F.col("at.page"), F.lit("None")))
    return rows.select("id", title.alias("title"), _colour(shown).alias("color"), size.cast("double").alias("size"))


def edges(shown: DataFrame, lit_edges: DataFrame) -> DataFrame:
    """(src, rel, dst, color, width)."""
    lit = lit_edges.select("src", "dst", F.lit(True).alias("__lit")).distinct()
    rows = shown.join(lit, ["src", "dst"], "left").crossJoin(F.broadcast(_any(lit_edges)))
    on = F.coalesce("__lit", F.lit(False))
    return rows.select("src", "rel", "dst", _colour(on).alias("color"), F.when(on, F.lit(2.5)).otherwise(F.lit(0.8)).alias("width"))


def page(node_rows: DataFrame, edge_rows: DataFrame) -> str:
    """A plain HTML page of what is rendered, which the edge limit bounds."""
    cell = lambda r: "".join(f"<td>{html.escape(str(x))}</td>" for x in r)
    body = "".join(f"<table>{''.join(f'<tr>{cell(r)}</tr>' for r in rows.toLocalIterator())}</table>" for rows in (node_rows, edge_rows))
    return f"<!DOCTYPE html><html><body style='margin:0'>{body}</body></html>"
