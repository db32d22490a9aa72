"""Sinks: collections, graphs, result records, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from graphloom.sources import tables


def add_vectors(new: DataFrame, path: str) -> None:
    """Append to a collection the rows whose id it lacks, one for each id. What is stored is never rewritten; partitions
    are the batches."""
    old = tables.collection(new.sparkSession, path)
    fresh = new.dropDuplicates(["id"]).join(old.select("id"), "id", "left_anti").select(old.columns)
    fresh.write.mode("append").parquet(path)


def append_results(records: DataFrame, path: str) -> None:
    """Append records of schemas.RESULTS as JSON lines, which ``tables.results`` reads; a crash loses the records of the
    running batch only."""
    records.write.mode("append").json(path)


def write_text(text: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
