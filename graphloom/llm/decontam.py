"""Benchmark decontamination by longest-common-subsequence and answer checks, with latent semantic cosines.

1. Statistics, one pass over all documents: words are hashed to TERMS terms, passages are blocks of STRIDE words. Each
   task counts in how many documents a term occurs, and adds its passages' term counts (0 or 1), with signs and into one of
   SKETCH rows drawn by a hash of the document and the passage's place. Rows of all tasks are summed. With the terms' idf as column weights this is S A, a random
   sketch of the TF-IDF passage matrix A; its right singular vectors are those of A up to the sketch's error (a
   randomised SVD in one pass). The sums have a fixed size whatever the corpus.
2. Search, one pass over all documents: segments of a document's words are compared with all benchmark items, in blocks
   of ITEMS items. An item is a candidate where the segment has the terms of ``part`` of its words: no leak has less,
   however frequent its passage is in the corpus.
3. Candidates are checked on the words around each block: the longest common subsequence with the item, and with the item's
   answer (its last sentence, or its last words). A document leaks an item if ``full`` of the item's words are found in
   order, or ``part`` of them together with the answer. The cosine of the leak's window and the item in the latent
   space (V / sigma) is reported, and decides nothing.

Nothing is sampled, and nothing grows with a document's copies: each row is checked where it is read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import materialise, parts, pieces, slices, text_bytes, word_hashes, word_spans

TERMS = 8192
SKETCH = 256
RANK = 128
STRIDE = 16  # words in a block; a window has two
ITEMS = 2000  # benchmark items compared at a time
ITEM_BYTES = 8 << 20  # and at most so many bytes of text
LEAST = 5  # shorter items are no evidence
SEED = 77


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end, byte where each word ends) of the joined texts."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    starts, ends = word_spans(data)
    first = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return word_hashes(data, starts, ends), np.concatenate([[0], np.searchsorted(starts, first)]), ends


def terms_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(51)).astype(np.int64)


def blocks_of(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text number) of the blocks of texts whose words are bounds[i] to bounds[i + 1]."""
    count = -(-np.diff(bounds) // STRIDE)
    text = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return bounds[:-1][text] + STRIDE * nth, text


def block_terms(term: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """(blocks, STRIDE) terms of the blocks that start at the words ``first`` in texts that end before ``last``. TERMS
    stands for no term: behind a text's end, and where a block has the term already (term frequencies are 0 or 1)."""
    at = first[:, None] + np.arange(STRIDE)
    out = np.append(term, TERMS).astype(np.int16)[np.where(at < last[:, None], at, len(term))]
    again = np.zeros(out.shape, bool)
    for k in range(1, STRIDE):
        again[:, k:] |= out[:, k:] == out[:, :-k]
    out[again] = TERMS
    return out


# --- statistics ---


def _sums(rows: DataFrame, keys: int, kind: str) -> DataFrame:
    """Sums of the vectors (``kind``: int32 or int64) of rows(r, salt, data), in each partition: at most ``keys`` are held."""

    def run(batches):
        import pyarrow as pa

        held: dict[tuple[int, int], np.ndarray] = defaultdict(lambda: np.zeros(TERMS, np.int64))
        for b in batches:
            for r, salt, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held[r, salt] += np.frombuffer(data, kind)
        for (r, salt), v in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([salt], pa.int32()), pa.array([v.tobytes()])], ["r", "salt", "data"])

    return rows.mapInArrow(run, "r int, salt int, data binary")


def draws(keys: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sketch row, sign is plus) of the blocks ``nth`` of documents with the hashes ``keys``, whatever task they are in."""
    x = (keys.view(np.uint64) ^ np.uint64(SEED)) + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    x ^= x >> np.uint64(31)
    return (x % np.uint64(SKETCH)).astype(np.int64), (x >> np.uint64(63)) == 1


def statistics(rows: DataFrame, salts: int = 16) -> tuple[np.ndarray, np.ndarray, int]:
    """(sketch of the passages' term counts, documents with each term, documents) over all rows(key, text). All sums are
    exact integers, so the order and the layout of the rows do not matter."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        sketch, with_term, n = np.zeros((SKETCH, TERMS), np.int32), np.zeros(TERMS, np.int32), 0
        for b in slices(batches):
            texts, keys = text_bytes(b.column(1)), b.column(0).to_numpy()
            n += len(texts)
            for lo, hi in pieces(texts):
                hashes, bounds, _ = tokens(texts[lo:hi])
                if not len(hashes):
                    continue
                term = terms_of(hashes)
                first, text = blocks_of(bounds)
                own = block_terms(term, first, bounds[1:][text]).astype(np.int64)
                row, plus = draws(keys[lo:hi][text], (first - bounds[:-1][text]) // STRIDE)
                at, there = row[:, None] * TERMS + own, own < TERMS
                for half, step in ((plus, 1), (~plus, -1)):
                    sketch += step * np.bincount(at[half][there[half]], minlength=SKETCH * TERMS).reshape(SKETCH, TERMS).astype(np.int32)
                for d in range(0, hi - lo, 64):
                    s, e = bounds[d], bounds[min(d + 64, hi - lo)]
                    doc = np.repeat(np.arange(min(64, hi - lo - d)), np.diff(bounds[d : d + 65]))
                    seen = np.zeros((64, TERMS), np.uint8)
                    seen[doc, term[s:e]] = 1
                    with_term += seen.sum(0, dtype=np.int32)
        if n:
            extra = np.zeros((2, TERMS), np.int32)
            extra[0], extra[1, 0] = with_term, n
            for k in range(0, SKETCH + 2, 32):
                data = [x.tobytes() for x in (*sketch, *extra)[k : k + 32]]
                yield pa.RecordBatch.from_arrays([pa.array(range(k, k + len(data)), pa.int32()), pa.array([task % salts] * len(data), pa.int32()), pa.array(data)], ["r", "salt", "data"])

    spark = rows.sparkSession
    made = rows.select("key", "text").mapInArrow(run, "r int, salt int, data binary")
    once = _sums(made.repartition(parts(spark), "r", "salt"), (SKETCH + 2) * salts, "int32")
    once = _sums(once.withColumn("salt", F.lit(0)).repartition(parts(spark), "r", "salt"), SKETCH + 2, "int64")
    out = np.zeros((SKETCH + 2, TERMS), np.int64)
    for r in once.select("r", "data").collect():  # SKETCH + 2 rows of a fixed size
        out[r["r"]] = np.frombuffer(r["data"], np.int64)
    return out[:SKETCH].astype(np.float64), out[SKETCH], int(out[SKETCH + 1, 0])


def latent(sketch: np.ndarray, with_term: np.ndarray, n: int, rank: int = RANK) -> np.ndarray:
    """(TERMS + 1, rank) rows to add up for a passage's terms: idf V / sigma; the last row, for padding, is zero."""
    idf = np.log((n + 1) / (with_term + 1)) + 1e-3
    a = sketch * idf
    values, u = np.linalg.eigh(a @ a.T)
    order = np.argsort(-values)[:rank]
    values, u = values[order], u[:, order]
    sound = values > values[:1] * 1e-9 if len(values) and values[0] > 0 else np.zeros(len(values), bool)
    sigma = np.sqrt(values[sound])
    v = a.T @ (u[:, sound] / sigma)  # right singular vectors
    out = np.zeros((TERMS + 1, max(1, int(sound.sum()))), np.float32)
    out[:TERMS, : len(sigma)] = idf[:, None] * v / sigma
    return out


# --- items and checks ---


@dataclass
class Items:
    ids: list
    words: list[list[int]]
    answers: list[tuple[int, int]]  # words of the answer, from and to
    groups: list[tuple[int, np.ndarray, np.ndarray]]  # of items by length: longest, item numbers, (TERMS, items) words with each term


def answer_span(text: bytes, ends: np.ndarray) -> tuple[int, int]:
    """The answer of an item whose words end at the bytes ``ends``: its last sentence, if it has several and that one
    has three words or more; else the last quarter of its words, four at least."""
    n = len(ends)
    marks = [k for k in range(n - 1) if text[ends[k] : ends[k] + 1] in (b".", b"?", b"!", b"\n")]
    if marks and n - marks[-1] - 1 >= 3:
        return marks[-1] + 1, n
    return max(0, n - max(4, n // 4)), n


def prepare(rows: list[tuple]) -> Items:
    """Items of (id, text) rows; those of fewer than LEAST words are left out."""
    ids, words, answers = [], [], []
    for i, text in rows:
        raw = (text or "").encode()
        hashes, _, ends = tokens([raw])
        if len(hashes) < LEAST:
            continue
        ids.append(i)
        words.append(hashes.tolist())
        answers.append(answer_span(raw, ends))
    length, groups = np.array([len(x) for x in words], np.int64), []
    level = np.maximum(np.ceil(np.log2(np.maximum(length, 1))), 6)  # up to 64 words, 128, 256, ...
    for own in (np.flatnonzero(level == k) for k in np.unique(level)):
        # sums over distinct terms are at most an item's length, so that they fit, too
        counts = np.zeros((TERMS, len(own)), np.min_scalar_type(int(length[own].max())))
        for k, i in enumerate(own.tolist()):
            counts[:, k] = np.bincount(terms_of(np.array(words[i], np.uint64)), minlength=TERMS)
        groups.append((int(length[own].max()), own, counts))
    return Items(ids, words, answers, groups)


def vectors_of(term: np.ndarray, starts: list[int], last: int, table: np.ndarray) -> np.ndarray:
    """Unit latent vectors of the windows of two blocks at the words ``starts`` of a text of ``last`` words."""
    v = np.zeros((len(starts), table.shape[1]))
    for k, s in enumerate(starts):
        first = np.arange(s, min(s + 2 * STRIDE, last), STRIDE)
        v[k] = table[block_terms(term, first, np.full(len(first), last))].sum((0, 1), dtype=np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-20)


def item_vectors(words: list[int], table: np.ndarray) -> np.ndarray:
    """The vectors of an item's windows."""
    n = len(words)
    at = sorted({*range(0, max(1, n - 2 * STRIDE + 1), STRIDE), max(0, n - 2 * STRIDE)})
    return vectors_of(terms_of(np.array(words, np.uint64)), at, n, table)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict[int, int] = defaultdict(int)
    for k, x in enumerate(a):
        places[x] |= 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def check(item: list[int], answer: tuple[int, int], near: list[int], least: float = 0.0) -> tuple[float, float]:
    """Shares of the item's and of its answer's words that ``near`` has in order; zeros, if the first is below ``least``."""
    if sum(map(set(near).__contains__, item)) < least * len(item):  # no subsequence is longer
        return 0.0, 0.0
    share = common_subsequence(item, near) / len(item)
    if share < least:
        return 0.0, 0.0
    tail = item[answer[0] : answer[1]]
    return share, common_subsequence(tail, near) / max(1, len(tail))


def search_texts(texts: list[bytes], items: Items, table: np.ndarray, full: float, part: float, answer: float):
    """(text number, item number, cosine, share, answer share) of the leaks: per text and item the best share."""
    out: dict[tuple[int, int], tuple[float, float, float]] = {}
    least = min(full, part)
    sets, vectors = [frozenset(x) for x in items.words], {}
    length = np.array([len(x) for x in items.words])
    for lo, hi in pieces(texts):
        hashes, bounds, _ = tokens(texts[lo:hi])
        term, words, ends = terms_of(hashes), hashes.tolist(), bounds.tolist()
        for longest, numbers, counts in items.groups:
            step, need = STRIDE * max(4, -(-longest // STRIDE)), np.ceil(least * length[numbers] - 1e-9).astype(counts.dtype)
            seen = np.zeros(TERMS, bool)
            for d, (b0, b1) in enumerate(zip(ends, ends[1:])):  # noqa: B905
                for s in range(b0, b1, step):
                    start, stop = max(b0, s - longest), min(b1, s + step + STRIDE + longest)
                    # an item with fewer of its words in the whole segment has no longer subsequence in it
                    seen.fill(False)
                    seen[term[start:stop]] = True
                    some = numbers[np.add.reduce(counts[seen.nonzero()[0]], 0, counts.dtype) >= need].tolist()
                    here = set(words[start:stop]) if some else ()
                    for i in some:
                        if not _possible(here, items.words[i], items.answers[i], full, part, answer):
                            continue
                        best = _best(words, start, stop, range(s, min(s + step, b1), STRIDE), b0, b1, i, items, sets[i], full, part, answer)
                        if best:
                            if i not in vectors:
                                vectors[i] = item_vectors(items.words[i], table)
                            share, tail, f = best
                            cosine = float((vectors[i] @ vectors_of(term[b0:b1], [f - b0], b1 - b0, table)[0]).max())
                            out[lo + d, i] = max(out.get((lo + d, i), (0.0, 0.0, 0.0)), (share, tail, cosine))
    return [(d, i, c, share, tail) for (d, i), (share, tail, c) in sorted(out.items())]


def _possible(here: set[int], item: list[int], span: tuple[int, int], full: float, part: float, answer: float) -> bool:
    """Whether a text of the words ``here`` in some order could leak the item: no common subsequence is longer than the
    number of words found."""
    share = sum(map(here.__contains__, item)) / len(item)
    if share < min(full, part):
        return False
    return share >= full or sum(map(here.__contains__, item[span[0] : span[1]])) / max(1, span[1] - span[0]) >= answer


def _best(words, start, stop, blocks, b0, b1, i, items, own, full, part, answer) -> tuple[float, float, int] | None:
    """(share, answer share, block) of the best leak of item ``i`` around one of the ``blocks`` of a text (words b0 to b1)."""
    item, span, best, done = items.words[i], items.answers[i], None, None
    need = min(full, part) * len(item)
    met = [k for k in range(start, stop) if words[k] in own]  # no other word is in a common subsequence
    for f in blocks:
        a, z = bisect_left(met, f - len(item)), bisect_left(met, f + 2 * STRIDE + len(item))
        if z - a < need or (a, z) == done:
            continue
        done = a, z
        near = [words[k] for k in met[a:z]]
        if not _possible(set(near), item, span, full, part, answer):
            continue
        share, tail = check(item, span, near, min(full, part))
        if share >= full or (share >= part and tail >= answer):
            best = max(best or (0.0, 0.0, -1), (share, tail, f))
    return best


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    full: float = 0.7, part: float = 0.5, answer: float = 0.8,
) -> DataFrame:
    """(id, text_hash, item_id, cosine, share, answer_share): documents and the benchmark items they leak.

    Null and empty texts leak nothing; null items and items of fewer than LEAST words are never leaked; repeated rows
    each give their rows; a null id keeps its rows (text_hash tells texts apart); an empty table on either side gives
    an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).where("length(text) > 0")
    table = spark.sparkContext.broadcast(latent(*statistics(rows.select(F.xxhash64("id", "text_hash").alias("key"), "text"))))  # TERMS x RANK, whatever the input
    kind, item_kind = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()

    def pass_over(items: Items) -> DataFrame:
        # words of ITEM_BYTES bytes of text, or of one item that is longer, and TERMS x ITEMS counts
        held = spark.sparkContext.broadcast(items)

        def run(batches):
            import pyarrow as pa

            own, to_latent = held.value, table.value
            ids = pa.array(own.ids)
            for b in slices(batches):
                found = search_texts(text_bytes(b.column(2)), own, to_latent, full, part, answer)
                if found:
                    doc, item, c, share, tail = (list(x) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), b.column(1).take(pa.array(doc)), ids.take(pa.array(item)), *map(pa.array, (c, share, tail))], ["id", "text_hash", "item_id", "cosine", "share", "answer_share"])

        return rows.mapInArrow(run, f"id {kind}, text_hash long, item_id {item_kind}, cosine double, share double, answer_share double")

    out, block, size = None, [], 0
    asked = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).cast("string").alias("t")).where("t is not null").orderBy("i", "t")
    for r in chain(asked.toLocalIterator(), [None]):  # a block is held at a time
        own = len(r["t"].encode()) if r else 0
        if block and (r is None or len(block) == ITEMS or size + own > ITEM_BYTES):
            items = prepare(block)
            if items.ids:
                found = pass_over(items)
                out = found if out is None else out.unionByName(found)
            block, size = [], 0
        if r is not None:
            block.append((r["i"], r["t"]))
            size += own
    return spark.createDataFrame([], f"id {kind}, text_hash long, item_id {item_kind}, cosine double, share double, answer_share double") if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that leak an item; columns are unchanged."""
    found = leaks(docs, benchmark, id_col, text_col, **options).select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    found = materialise(found, "decontam")
    here = F.xxhash64(docs[text_col].cast("string"))
    return docs.join(found, docs[id_col].eqNullSafe(F.col("__id")) & (here == F.col("__hash")), "left_anti")
