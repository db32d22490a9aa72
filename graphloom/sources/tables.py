"""Sources: tables, PDF folders, questions, results, collections. Missing optional inputs are empty tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schemas

FIRST_PAGE, LAST_PAGE = 5, 34


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content) of matching files, not recursive; a missing folder raises, no match is empty."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def pages(found: DataFrame, extract) -> DataFrame:
    """(doc_id, page_idx, text) of files; ``extract(bytes) -> list of page texts``. A file that fails gives no page."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    texts = extract(bytes(content))
                except Exception:
                    continue
                yield pd.DataFrame({"doc_id": path.rpartition("/")[2], "page_idx": range(len(texts)), "text": texts})

    return found.mapInPandas(run, schemas.PAGES)


def page_range(rows: DataFrame, index: str = "page_idx", text: str = "text", first: int = FIRST_PAGE, last: int = LAST_PAGE) -> DataFrame:
    """Pages of the range that have text; the range reaches the scan as a filter."""
    return rows.where(F.col(index).between(first, last) & (F.length(text) > 0))


def document_text(rows: DataFrame, by: str, index: str, text: Column) -> DataFrame:
    """All pages of a document in order, with nothing between."""
    parts = F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.coalesce(text, F.lit("")).alias("t"))))
    return rows.groupBy(by).agg(parts.alias("__p")).select(by, F.array_join(F.col("__p")["t"], "").alias("text"))


def questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.QUESTIONS).option("multiLine", True).json(path)


def results(spark: SparkSession, path: str, required: bool = False, array: bool = False) -> DataFrame:
    """Records of earlier runs as ``sinks.append_results`` writes them, JSON lines; ``array``: one JSON array a file. A
    missing path is empty unless required."""
    return _optional(spark, lambda: spark.read.schema(schemas.RESULTS).option("multiLine", array).json(path), schemas.RESULTS, required)


def collection(spark: SparkSession, path: str) -> DataFrame:
    """A vector collection; a missing one is empty."""
    return _optional(spark, lambda: spark.read.schema(schemas.VECTORS).parquet(path), schemas.VECTORS, False)


def _optional(spark: SparkSession, read, schema: str, required: bool) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if required or "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
