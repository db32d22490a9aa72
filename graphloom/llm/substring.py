"""Substring dedup by content-defined chunking.

A gear rolling hash over the UTF-8 bytes, h = (h << 1) + gear[byte] mod 2^16, ends a chunk where it is smallest among
its neighbours, REACH on either side. A boundary depends on the bytes around it only, so it moves with the text: an
insertion changes the chunks around it and no others. Chunks are deduplicated by digest; the two smallest documents
that hold a digest are its holders. Occurrences in later documents are merged along diagonals (position here minus
position there), then the bytes of both are compared around each diagonal, farther where they are equal up to the
window's end, which gives exact maximal passages. Those of at least ``min_words`` words are repeats.

Distribution: digests are aggregated with map-side combining, joined by equality (a hot digest is split by AQE), and
one document costs rows in proportion to its own length, however many documents share a passage with it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import FEW, materialise, slices, text_bytes

REACH = 24  # a boundary every 49 bytes, and none nearer than this but for ties
TIES = 64  # of equal hashes in reach of one another, as in periodic texts, one in so many bytes
SHORTEST = 16  # shorter chunks are no evidence
AROUND = 512  # bytes compared on either side of a diagonal's chunks, and EDGE of them equal at an end: eight times as many
EDGE = 128
WINDOW = 16
#: White space counts as equal, byte for byte, so that a passage may be wrapped differently.
FLAT = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")
GEAR = np.random.default_rng(20_240_607).integers(0, 1 << 16, 256, np.uint16)


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a uint8 array, the array's end included."""
    if not len(data):
        return np.zeros(0, np.int64)
    h = GEAR[data]
    step = 1
    while step < WINDOW:  # h covers the last `step` bytes; twice as many after each pass
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint16(step)
        h = h + older
        step *= 2
    n = len(data)
    least = np.full(n + 2 * REACH, 0xFFFF, np.uint16)
    least[REACH : REACH + n] = h
    span = 1
    while span < 2 * REACH + 1:  # least covers `span` positions from here on
        more = min(span, 2 * REACH + 1 - span)
        least = np.minimum(least[: len(least) - more], least[more:])
        span += more
    ends = np.flatnonzero(h == least) + 1
    far = np.diff(ends, prepend=-REACH - 1) > REACH
    if not far.all():
        chain = np.cumsum(far) - 1
        nth = (ends - ends[far][chain]) // TIES
        far[1:] |= nth[1:] != nth[:-1]
        ends = ends[far]
    return ends if len(ends) and ends[-1] == n else np.append(ends, n)


def chunk_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start, length, digest) of the indexed chunks, each at all its places: a text may hold a passage several times."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    rows, starts, lengths, digests = [], [], [], []
    for k, text in enumerate(texts):
        text = text.translate(FLAT)
        ends = boundaries(np.frombuffer(text, np.uint8))
        size = np.diff(ends, prepend=0)
        long = size >= SHORTEST
        own = list(zip((ends - size)[long].tolist(), ends[long].tolist(), strict=True))
        rows += [k] * len(own)
        digests += [digest(text[s:e]) for s, e in own]
        starts += [s for s, _ in own]
        lengths += [e - s for s, e in own]
    return np.array(rows, np.int64), np.array(starts, np.int32), np.array(lengths, np.int32), np.array(digests, np.uint64).view(np.int64)


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, digest) of the indexed chunks; null ids are left out."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            row, start, length, digest = chunk_texts(text_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(digest)], ["id", "start", "length", "digest"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and length(text) > 0")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, start int, length int, digest long")


def equal_spans(here: bytes, there: bytes, min_words: int, before: bytes = b"") -> list[tuple[int, int, int]]:
    """(start, length, words) in ``here`` of the maximal runs equal to ``there``, byte by byte (white space being
    equal), cut to whole words of ``here`` and of at least ``min_words`` of them. before: the byte before ``here``, empty at a text's start."""
    n = min(len(here), len(there))
    same = np.frombuffer(here.translate(FLAT), np.uint8, n) == np.frombuffer(there.translate(FLAT), np.uint8, n)
    edge = np.diff(same.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    out = []
    for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        left = here[s - 1 : s] if s else before
        if left and not left.isspace() and not here[s : s + 1].isspace():
            cut = here[s:e].split(None, 1)
            s = e - len(cut[1]) if len(cut) > 1 else e
        if e < len(here) and not here[e : e + 1].isspace() and not here[e - 1 : e].isspace():
            cut = here[s:e].rsplit(None, 1)
            e = s + len(cut[0]) if len(cut) > 1 else s
        own = here[s:e]
        s, e = e - len(own.lstrip()), s + len(own.rstrip())
        words = len(own.split())
        if words >= min_words:
            out.append((s, e - s, words))
    return out


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """(id, text_hash, first_id, start, length, words): passages of at least ``min_words`` words (between ASCII white
    space) of a document that an earlier one (smaller id) holds too; start and length are in UTF-8 bytes. Overlapping
    finds of a document are merged; first_id is then the smallest, and words the largest of their numbers of words.

    Repeats within one document are none. Null ids and null or empty texts have no repeats. Rows that share an id
    are one document's versions: never repeats of each other, and told apart by text_hash. An empty table gives an empty
    result. Other columns are not read. A passage between whose ends no chunk lies that one of the holders has beside
    it is missed: see the README for how many are.
    """
    found = materialise(chunks(docs, id_col, text_col), "substring-chunks")
    shared = found.groupBy("digest").agg(F.min("id").alias("least_id"), F.max("id").alias("__last")).where("least_id <> __last").drop("__last")
    shared = materialise(shared, "substring-shared")  # a plain table beside each join, so that AQE can split a hot digest
    held = materialise(found.join(shared, "digest"), "substring-held")
    least = lambda which: F.min(F.when(F.expr(which), F.struct("id", "start")))
    holders = held.groupBy("digest").agg(least("id = least_id").alias("first"), least("id <> least_id").alias("second"))
    holders = holders.select("digest", F.explode(F.array("first", "second")).alias("h")).select("digest", F.col("h.id").alias("first_id"), F.col("h.start").alias("there"))
    holders = materialise(holders, "substring-holders")
    pairs = held.where("id <> least_id").join(holders, "digest").where("first_id < id")
    pairs = pairs.withColumn("shift", F.col("start") - F.col("there"))
    runs = pairs.groupBy("id", "first_id", "shift").agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("length")).alias("high"))
    runs = materialise(runs.withColumn("around", F.lit(AROUND)), "substring-runs")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).where("id is not null")
    spans, near = None, lambda df: df.hint("merge")  # the first windows are many
    while True:  # at most as many rounds as it takes from AROUND to the longest text, by factors of eight
        seen = materialise(_compared(runs, texts, min_words, near), "substring-spans")
        closed = seen.where("around is null").select("id", "first_id", "text_hash", "start", "length", "words")
        spans = closed if spans is None else spans.unionByName(closed)
        open_ = seen.where("around is not null")
        if not (left := open_.count()):
            return _merged(spans)
        runs = open_.select("id", "first_id", "shift", "low", "high", (F.col("around") * 8).alias("around")).distinct()
        if left <= FEW:
            near = F.broadcast
        else:
            runs = materialise(runs, "substring-runs")


def _compared(runs: DataFrame, texts: DataFrame, min_words: int, near) -> DataFrame:
    """The passages (id, first_id, text_hash, start, length, words) of runs(id, first_id, shift, low, high, around), whose
    bytes are compared from ``around`` before low to ``around`` behind high; a window that is equal up to an end, where the
    texts go on, is given back instead (around is null in the rows of passages). ``near`` is how runs are joined to texts."""
    begin = F.greatest(F.col("low") - F.col("around"), F.lit(0), F.col("shift"))
    runs = runs.withColumn("here", begin).withColumns({"there": F.col("here") - F.col("shift"), "size": F.col("high") + F.col("around") - F.col("here")})
    window = lambda at: F.expr(f"substring(text, {at} + 1, size + 1)")
    here = texts.join(near(runs), "id").select(*runs.columns, F.xxhash64("text").alias("text_hash"), window("here").alias("own"), F.expr("if(here > 0, substring(text, here, 1), cast('' as binary))").alias("before"))
    ends = texts.withColumnRenamed("id", "first_id").join(near(runs.select("first_id", "there", "size").distinct()), "first_id").select("first_id", "there", "size", window("there").alias("other"))
    names = ["id", "first_id", "text_hash", "shift", "low", "high", "around", "here", "there", "size", "own", "before", "other"]
    both = here.join(ends, ["first_id", "there", "size"]).select(*names)
    kind = both.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            at, out, again = [], [], []
            for k, (first, there, size, own, before, other) in enumerate(zip(*(b.column(c).to_pylist() for c in (7, 8, 9, 10, 11, 12)), strict=True)):
                if _goes_on(own, other, size, first > 0 and there > 0):
                    again.append(k)
                    continue
                spans = equal_spans(own, other[:size], min_words, before)
                at += [k] * len(spans)
                out += [(first + s, n, w) for s, n, w in spans]
            rows = b.select(range(7)).take(pa.array(at + again, pa.int64()))
            none = [None] * len(again)
            around = pa.array([None] * len(at) + rows.column(6).to_pylist()[len(at) :], pa.int32())
            made = [pa.array([s[c] for s in out] + none, pa.int32()) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*rows.columns[:6], around, *made], [*names[:7], "start", "length", "words"])

    return both.mapInArrow(run, f"id {kind}, first_id {kind}, text_hash long, shift int, low int, high int, around int, start int, length int, words int")


def _goes_on(own: bytes, other: bytes, size: int, left: bool) -> bool:
    """Whether EDGE bytes are equal at an end of two windows of ``size`` bytes (and one more, if the text has it)."""
    if size < EDGE:
        return False
    if left and own[:EDGE].translate(FLAT) == other[:EDGE].translate(FLAT):
        return True
    return min(len(own), len(other)) > size and own[size - EDGE : size].translate(FLAT) == other[size - EDGE : size].translate(FLAT)


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping spans of a text as one; a text has at most as many spans as diagonals with a long passage."""
    lists = spans.groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", F.expr("start + length").alias("end"), "words", "first_id"))).alias("s"))
    joined = F.expr(
        """aggregate(s, slice(s, 1, 0), (done, x) ->
             if(size(done) > 0 and x.start <= try_element_at(done, -1).end,
                concat(slice(done, 1, size(done) - 1), array(named_struct('start', try_element_at(done, -1).start, 'end', greatest(try_element_at(done, -1).end, x.end),
                  'words', greatest(try_element_at(done, -1).words, x.words), 'first_id', least(try_element_at(done, -1).first_id, x.first_id)))),
                concat(done, array(x))))"""
    )
    out = lists.select("id", "text_hash", F.explode(joined).alias("m"))
    return out.select("id", "text_hash", "m.first_id", "m.start", F.expr("m.end - m.start").alias("length"), "m.words")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50) -> DataFrame:
    """``docs`` with each repeat cut out of the later documents; the first holder keeps it. All rows stay, with the
    same columns; a text that is one repeat becomes empty. The white space around a cut stays."""
    found = repeats(docs, id_col, text_col, min_words)
    cuts = found.groupBy(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("__cuts"))
    raw = F.col(text_col).cast("string").cast("binary")
    rows = docs.join(cuts, (docs[id_col] == F.col("__id")) & (F.xxhash64(raw) == F.col("__hash")), "left")
    rows = rows.withColumn("__raw", raw)
    pieces = F.expr(
        """transform(sequence(0, size(__cuts)), k -> cast(substring(__raw,
             if(k = 0, 1, try_element_at(__cuts, greatest(k, 1)).start + try_element_at(__cuts, greatest(k, 1)).length + 1),
             if(k = size(__cuts), length(__raw), try_element_at(__cuts, k + 1).start - if(k = 0, 0, try_element_at(__cuts, greatest(k, 1)).start + try_element_at(__cuts, greatest(k, 1)).length))) as string))"""
    )
    left = F.when(F.col("__cuts").isNull(), F.col(text_col)).otherwise(F.array_join(pieces, ""))
    return rows.withColumn(text_col, left).select(docs.columns)
