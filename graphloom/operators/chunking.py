"""Chunks: exact recursive character splitting, fixed overlapping windows, chunk numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VECTOR_SEPARATORS = ("\n\n", "\n", ". ", " ", "")
GRAPH_SEPARATORS = ("\n\n", "\n", " ", "")


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Pieces of at most ``size`` characters (unless no separator can cut them), merged greedily with ``overlap``.

    The first separator found in the text cuts it, staying at the start of the next piece. Short pieces are merged;
    a long one is cut with the remaining separators.
    """
    at = next((k for k, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    mark, finer = separators[at], separators[at + 1 :]
    if mark:
        head, *rest = text.split(mark)
        pieces = [p for p in (head, *(mark + r for r in rest)) if p]
    else:
        pieces = list(text)
    out: list[str] = []
    short: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            short.append(piece)
            continue
        out += _merge(short, size, overlap)
        short = []
        out += split_recursive(piece, size, overlap, finer) if finer else [piece]
    return out + _merge(short, size, overlap)


def _merge(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, held, total = [], [], 0
    for piece in pieces:
        if held and total + len(piece) > size:
            if whole := "".join(held).strip():
                out.append(whole)
            drop = 0
            while total > overlap or (total > 0 and total + len(piece) > size):
                total -= len(held[drop])
                drop += 1
            held = held[drop:]
        held.append(piece)
        total += len(piece)
    if whole := "".join(held).strip():
        out.append(whole)
    return out


def chunk_recursive(docs: DataFrame, id_col: str, text: Column, size: int = 1200, overlap: int = 250, separators: tuple[str, ...] = VECTOR_SEPARATORS) -> DataFrame:
    """(id_col, chunk_pos, chunk): one Arrow pass; null texts give no chunk."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, places, chunks = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                found = split_recursive(t, size, overlap, separators) if t else []
                ids += [k] * len(found)
                places += range(len(found))
                chunks += found
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(places, pa.int32()), pa.array(chunks, pa.string())], [id_col, "chunk_pos", "chunk"])

    rows = docs.select(id_col, text.alias("text"))
    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, chunk_pos int, chunk string")


def chunk_fixed(docs: DataFrame, id_col: str, text: Column, size: int = 1200, overlap: int = 250) -> DataFrame:
    """(id_col, chunk_pos, chunk): windows of ``size`` characters, ``size - overlap`` apart, without trailing windows
    that add nothing. No Python."""
    step = size - overlap
    rows = docs.select(id_col, text.alias("__t")).where(F.length("__t") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.length("__t") - size) / F.lit(step))).cast("int")
    rows = rows.select(id_col, "__t", F.explode(F.sequence(F.lit(0), last)).alias("chunk_pos"))
    return rows.select(id_col, "chunk_pos", F.expr(f"substring(__t, chunk_pos * {step} + 1, {size})").alias("chunk"))


def chunk_numbers(chunks: DataFrame, id_col: str, prefix: str = "baseline_chunk_", bucket: Column | None = None) -> DataFrame:
    """``chunks`` with chunk_no (global, from 0, by id and position) and chunk_id.

    The running count has two levels: over buckets of ids, and over the documents within a bucket. ``bucket`` must
    rise with the id; by default it is id / 65536 (for integer ids), so no window sees more than that many rows or
    one row a bucket.
    """
    bucket = F.shiftright(F.col(id_col), 16) if bucket is None else bucket
    docs = chunks.groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")).withColumn("__bucket", bucket)
    sums = docs.groupBy("__bucket").agg(F.sum("__n").alias("__all"))
    sums = sums.select("__bucket", F.coalesce(F.sum("__all").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__bucket").orderBy(id_col).rowsBetween(Window.unboundedPreceding, -1)
    starts = docs.withColumn("__own", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(sums, "__bucket")
    starts = starts.select(id_col, (F.col("__own") + F.col("__base")).alias("__start"))
    out = chunks.join(starts, id_col).withColumn("chunk_no", F.col("__start") + F.col("chunk_pos")).drop("__start")
    return out.withColumn("chunk_id", F.concat(F.lit(prefix), F.lpad(F.col("chunk_no").cast("string"), 6, "0")))


def chunk_counts(chunks: DataFrame, id_col: str, batch: int = 100) -> DataFrame:
    """Chunks of each document, and insert batches of ``batch`` rows they would need."""
    n = F.count(F.lit(1))
    return chunks.groupBy(id_col).agg(n.alias("n_chunks"), F.ceil(n / batch).cast("long").alias("n_batches"))
