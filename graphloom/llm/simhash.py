"""SimHash near-dedup by binary trie self-joins.

Fingerprints are majority votes over the bits of hashed word shingles. Equal fingerprints form a class; the distinct
ones are joined with themselves in a binary trie: pairs of trie nodes are traversed together from the root, the
bits in which they differ are added up, and a pair is dropped as soon as its error budget is exceeded.

``near_duplicates`` links fingerprints of 64 bits (XXH64) that differ in a few bits. ``keep_one_alike`` is for a similarity of
word sets: WORDS fingerprints of each set of shingles are joined, each in a trie of its own whose first LEVELS levels
allow BUDGET differing bits; what is near in the whole word and in two others besides is a candidate, and the sets
of candidates are compared exactly.

Distribution: the first ``p`` levels of a trie give 2^p subtrees; one group is one pair of subtrees whose prefixes are
within budget, and is traversed in one task with vectors. ``p`` follows the number of fingerprints; a subtree
that is dense all the same is split into blocks by hash, and pairs of blocks are groups. A group gives a spanning
forest of its links, never the links themselves, so a group of k near copies costs k - 1 rows. Components are
found with distributed rounds.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import beside, components, materialise, parts, pieces, slices, text_bytes, word_hashes

SUBTREE = 65_536  # fingerprints in a subtree, about
DENSE = 4 * SUBTREE  # and at most, in one block of it
BLOCK = 1 << 19  # node pairs or fingerprint pairs handled at a time

# Candidates for sets of shingles. At a Jaccard similarity of 0.8 the angle between two sets is 27 degrees, so a bit differs
# with probability 0.152; a pair passes one word's trie with probability 0.395, and none of WORDS with 0.0003.
WORDS = 16  # fingerprints of a set
LEVELS = 20  # of a trie
BUDGET = 2  # differing bits there
IN_WORD = 18  # in the whole word, and
IN_OTHERS = 36  # in the two next words: four standard deviations above the mean at that similarity
MEMBERS = 512  # sets compared with each other in one task, about
SHINGLES = 1 << 20  # and shingles there, about
SPACE = np.zeros(256, bool)
SPACE[list(b" \t\n\r\x0b\x0c")] = True
_MULT = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.random.default_rng(20_240_611).integers(0, 1 << 63, WORDS, np.uint64)


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of one text: A-Z folded, words between ASCII white space, ``width``-word shingles with
    repeats. Fewer words than ``width``: the whole sequence is the only shingle; none: 0."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)], np.uint64)
    bits, n = np.zeros(64, np.int64), len(hashes)
    for at in range(0, n, 65_280):
        part = hashes[at : at + 65_280]
        part = np.concatenate([part, np.zeros(-len(part) % 255, np.uint64)])
        spread = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bits += spread.reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, text_hash, fp): fp is the fingerprint as a signed long. A null text counts as empty."""

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            fps = np.array([fingerprint(x, width, seed) for x in text_bytes(b.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(fps.view(np.int64))], ["id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_hash long, fp long")


class Trie:
    """A binary trie over sorted distinct uint64 values, level by level: each node is a range of values."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.levels: dict[int, tuple[np.ndarray, ...]] = {}
        self.members: dict[int, np.ndarray] = {}

    def _members(self, depth: int) -> np.ndarray:
        if depth not in self.members:
            keys = self.values >> np.uint64(64 - depth) if depth else np.zeros(len(self.values), np.uint64)
            self.members[depth] = np.cumsum(np.diff(keys, prepend=keys[:1]) != 0)
        return self.members[depth]

    def level(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """low, high (bounds in values), zero and one (children's numbers at the next depth, or -1) of the nodes."""
        if depth not in self.levels:
            own = self._members(depth)
            low = np.flatnonzero(np.diff(own, prepend=-1))
            high = np.append(low[1:], len(own))
            if depth < 64:
                below, bit = self._members(depth + 1), (self.values >> np.uint64(63 - depth)) & np.uint64(1)
                zero = np.where(bit[low] == 0, below[low], -1)
                one = np.where(bit[high - 1] == 1, below[high - 1], -1)
            else:
                zero = one = np.full(len(low), -1)
            self.levels[depth] = low, high, zero, one
        return self.levels[depth]


def trie_links(a: Trie, b: Trie, budget: int, depth: int = 0, spent: int = 0, levels: int = 64):
    """Blocks (i, j) of positions in a.values and b.values that differ in at most ``budget`` of the first ``levels`` bits;
    for one trie with itself each pair once, i < j. The roots are the subtrees at ``depth`` that hold all values of
    each trie and differ in ``spent`` bits. Memory is bounded by BLOCK pairs a level."""
    if not len(a.values) or not len(b.values):
        return
    same = a is b
    stack = [(depth, np.zeros(1, np.int64), np.zeros(1, np.int64), np.full(1, spent))]
    while stack:
        d, x, y, cost = stack.pop()
        if len(x) > BLOCK:
            half = len(x) // 2
            stack += [(d, x[:half], y[:half], cost[:half]), (d, x[half:], y[half:], cost[half:])]
            continue
        xl, xh, x0, x1 = a.level(d)
        yl, yh, y0, y1 = b.level(d)
        sizes = (xh[x] - xl[x]) * (yh[y] - yl[y])
        leaf = (sizes <= 16) | (d == levels)
        if leaf.any():
            yield from _leaves(a.values, b.values, xl[x[leaf]], yl[y[leaf]], yh[y[leaf]] - yl[y[leaf]], sizes[leaf], budget, same, levels)
            x, y, cost = x[~leaf], y[~leaf], cost[~leaf]
        if len(x):
            twin = same & (x == y)
            steps = [(x0[x], y0[y], cost), (x1[x], y1[y], cost), (x0[x], y1[y], cost + 1), (x1[x], y0[y], cost + 1)]
            if same:
                steps[3] = (np.where(twin, -1, steps[3][0]), steps[3][1], steps[3][2])
            kept = [(u >= 0) & (v >= 0) & (c <= budget) for u, v, c in steps]
            grown = [np.concatenate([s[k][m] for s, m in zip(steps, kept, strict=True)]) for k in range(3)]
            if len(grown[0]):
                stack.append((d + 1, *grown))


def _leaves(av, bv, alow, blow, width, sizes, budget, same, levels):
    ends = np.cumsum(sizes)
    total = int(ends[-1])
    for at in range(0, total, BLOCK):
        flat = np.arange(at, min(total, at + BLOCK))
        pair = np.searchsorted(ends, flat, "right")
        offset = flat - (ends[pair] - sizes[pair])
        i, j = alow[pair] + offset // width[pair], blow[pair] + offset % width[pair]
        near = np.bitwise_count((av[i] ^ bv[j]) >> np.uint64(64 - levels)) <= budget
        if same:
            near &= i < j
        if near.any():
            yield i[near], j[near]


def join_forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite a[k] and b[k] in the forest ``parent``, whose parents are never larger than their children."""
    while len(a):
        a, b = _roots(parent, a), _roots(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def _roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = parent[x]
    while (up := parent[x]).tobytes() != x.tobytes():
        x = up
    return x


def _cells(rows: DataFrame, p: int, budget: int) -> DataFrame:
    """``rows``(t, fp, ...) once for each group they meet in: low and high are its cells (a prefix of ``p`` bits, and a
    block of a dense prefix), ``right`` says that the row is of the high one."""
    prefix = F.shiftrightunsigned("fp", 64 - p) if p else F.lit(0).cast("long")
    rows = rows.withColumn("own", prefix)
    # at most WORDS x 2^p rows, whatever the input
    dense = [(r["t"], r["own"], -(-r["count"] // DENSE)) for r in rows.groupBy("t", "own").count().where(F.col("count") > DENSE).collect()]
    masks = [m for m in range(1 << p) if m.bit_count() <= budget]
    rows = rows.withColumn("other", F.explode(F.transform(F.lit(masks).cast("array<bigint>"), lambda m: F.col("own").bitwiseXOR(m))))
    one = F.lit(1).cast("long")
    if dense:
        blocks = rows.sparkSession.createDataFrame(dense, "t int, own long, blocks long")
        rows = rows.join(F.broadcast(blocks.withColumnRenamed("blocks", "b_own")), ["t", "own"], "left")
        rows = rows.join(F.broadcast(blocks.select("t", F.col("own").alias("other"), F.col("blocks").alias("b_other"))), ["t", "other"], "left")
        block = F.pmod(F.xxhash64("fp"), F.coalesce("b_own", one))
        rows = rows.withColumn("own", F.shiftleft("own", 24) + block)
        rows = rows.withColumn("other", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("b_other", one) - 1), lambda b: F.shiftleft("other", 24) + b)))
    else:
        rows = rows.withColumns({"own": F.shiftleft("own", 24), "other": F.shiftleft("other", 24)})
    kept = [c for c in rows.columns if c not in ("t", "own", "other", "b_own", "b_other")]
    return rows.select("t", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.expr("own > other").alias("right"), *kept)


def _joined(rows: DataFrame, p: int, budget: int, levels: int, limits: tuple[int, int] | None = None) -> DataFrame:
    """A spanning forest (a, b) of the links between the ``node``s of rows(t, fp, node) of the same table t, whose fp differ
    in at most ``budget`` of the first ``levels`` bits; and with limits, in at most limits[0] bits of fp and limits[1] of
    the further columns next and after."""
    spark = rows.sparkSession

    def run(group):
        import pyarrow as pa

        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        longs = {c: group.column(c).to_numpy().view(np.uint64) for c in group.column_names if c in ("fp", "next", "after")}
        node, right = group.column("node").to_numpy(), group.column("right").to_numpy(zero_copy_only=False)
        sides = []
        for own in (np.flatnonzero(~right), np.flatnonzero(right)):
            sides.append(own[np.argsort(longs["fp"][own], kind="stable")])
        order = np.concatenate(sides)
        first = Trie(longs["fp"][sides[0]])
        second = first if low == high else Trie(longs["fp"][sides[1]])
        shift = 0 if low == high else len(sides[0])
        parent = np.arange(len(order))
        held = {c: x[order] for c, x in longs.items()}
        for i, j in trie_links(first, second, budget, p, ((low ^ high) >> 24).bit_count(), levels):
            j = j + shift
            if limits:
                near = np.bitwise_count(held["fp"][i] ^ held["fp"][j]) <= limits[0]
                i, j = i[near], j[near]
                near = np.bitwise_count(held["next"][i] ^ held["next"][j]) + np.bitwise_count(held["after"][i] ^ held["after"][j]) <= limits[1]
                i, j = i[near], j[near]
            join_forest(parent, i, j)
        root = _roots(parent, np.arange(len(order)))
        child = root != np.arange(len(order))
        return pa.table({"a": node[order[child]], "b": node[order[root[child]]]})

    sides = _cells(rows, p, budget)
    n = max(parts(spark), 4 * spark.sparkContext.defaultParallelism)
    return sides.repartition(n, "t", "low", "high").groupBy("t", "low", "high").applyInArrow(run, "a long, b long")


def linked(fps: DataFrame, budget: int = 4) -> DataFrame:
    """A spanning forest (a, b) of the links between the distinct longs of ``fps(fp)`` at ``budget`` differing bits
    or fewer. Which edges it has depends on the subtrees; its components do not."""
    p = min(12, max(4, math.ceil(math.log2(max(1, fps.count()) / SUBTREE))))
    return _joined(fps.select(F.lit(0).alias("t"), "fp", F.col("fp").alias("node")), p, budget, 64)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp, component, text_hash): one row per row of ``docs``; component is the smallest id reachable over links between
    fingerprints that differ in at most ``budget`` bits.

    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows each get a row; a null id
    keeps its row and never becomes a component (null only where a component has no other id). An empty table gives
    an empty result. Other columns, whatever their names, are not read.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, width, seed), "simhash-fp")
    classes = materialise(rows.groupBy("fp").agg(F.min("id").alias("first")), "simhash-class")
    roots = components(linked(classes.select("fp"), budget), "simhash-cc").withColumnRenamed("node", "fp")
    near = classes.join(roots, "fp")
    # plain tables beside each join on a key that may be hot, so that AQE can split it
    smallest = materialise(near.groupBy("root").agg(F.min("first").alias("component")), "simhash-smallest")
    found = near.join(smallest, "root").select("fp", "component")
    found = materialise(classes.join(found, "fp", "left").select("fp", F.coalesce("component", "first").alias("component")), "simhash-found")
    return rows.join(found, "fp").select("id", "fp", "component", "text_hash")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4) -> DataFrame:
    """``docs`` without the near duplicates by fingerprint: of each component the rows whose id is the smallest stay. Rows
    without an id all stay; each row is decided by its own text, also where an id is repeated; equal rows stay or go
    together; an empty table gives an empty result. Columns are unchanged."""
    return _without(docs, near_duplicates(docs, id_col, text_col, width, budget), id_col, text_col)


def _without(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows of found(id, text_hash, component) whose id is not their component."""
    gone = found.where(F.col("id").isNotNull() & (F.col("id") != F.col("component")))
    gone = materialise(gone.select(F.col("id").alias("__gone"), F.col("text_hash").alias("__hash")).distinct(), "simhash-gone")
    return docs.join(beside(gone), (docs[id_col] == F.col("__gone")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("__hash")), "left_anti")


# --- sets of shingles ---


def _mix(h: np.ndarray, x) -> np.ndarray:
    h = (h ^ x) * _MULT
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's ``width``-word shingles: A-Z folded, words between ASCII white space. Fewer
    words than ``width``: the whole sequence is the only shingle; none: no shingle."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    edge = np.diff((~SPACE[data]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    bounds = np.concatenate([[0], np.searchsorted(starts, first)])
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    text = np.repeat(np.arange(len(texts)), count)
    at = bounds[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    words = np.append(word_hashes(data, starts, ends), np.zeros(width, np.uint64))
    out, last = np.zeros(len(at), np.uint64), bounds[1:][text]
    for k in range(width):
        out = _mix(out, np.where(at + k < last, words[at + k], np.uint64(0)))
    return [np.unique(x) for x in np.split(out, np.cumsum(count)[:-1])]


def words_of(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, WORDS) SimHash words of sets that are not empty: bit k of word w is set if over half of the shingles' hashes
    for w have it. Eight bits at a time are added up in the bytes of a long, 255 shingles at most."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    if not len(sets):
        return np.zeros((0, WORDS), np.uint64)
    runs = -(-size // 255)
    first_run = np.cumsum(runs) - runs
    nth = np.arange(runs.sum()) - np.repeat(first_run, runs)
    starts = np.repeat(np.cumsum(size) - size, runs) + 255 * nth
    h, lanes = np.concatenate(sets), np.uint64(0x0101010101010101)
    out = np.zeros((len(sets), WORDS), np.uint64)
    for w in range(WORDS):
        x = _mix(h, _SALT[w])
        x = _mix(x, x >> np.uint64(32))
        for k in range(8):
            sums = np.add.reduceat((x >> np.uint64(k)) & lanes, starts)
            votes = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), first_run, axis=0, dtype=np.int64)
            out[:, w] |= (2 * votes > size[:, None]).view(np.uint8).view(np.uint64).ravel() << np.uint64(k)
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, text_hash, digest, n, words): digest, size and SimHash words (null, if empty) of the set of shingles."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for b in slices(batches):
            texts = text_bytes(b.column(2))
            for lo, hi in pieces(texts):
                sets = shingle_sets(texts[lo:hi], width)
                digest = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
                size = np.array([len(x) for x in sets], np.int32)
                offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, WORDS, 0))]).astype(np.int32)
                flat = pa.array(words_of([x for x in sets if len(x)]).ravel().view(np.int64))
                words = pa.ListArray.from_arrays(pa.array(offsets), flat, mask=pa.array(size == 0))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(digest), pa.array(size), words], ["id", "text_hash", "digest", "n", "words"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text_hash long, digest long, n int, words array<long>")


def candidates(classes: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of the candidate pairs of classes(digest, words)."""
    n = classes.count()
    p = min(12, max(0, math.ceil(math.log2(max(1, n) / DENSE))))
    rows = classes.where("words is not null").select(F.col("digest").alias("node"), F.posexplode("words").alias("t", "fp"), "words")
    at = lambda k: F.get("words", F.pmod(F.col("t") + k, F.lit(WORDS)))
    return _joined(rows.select("t", "fp", "node", at(1).alias("next"), at(2).alias("after")), p, BUDGET, LEVELS, (IN_WORD, IN_OTHERS))


def alike(sets: list[np.ndarray], least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of all pairs of sets whose Jaccard similarity is ``least`` or more, by products of 0/1 matrices over
    the shingles that two sets or more have, 4,096 at a time."""
    m, size = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(m), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    place = np.cumsum(count > 1) - 1
    owner, column = owner[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = int((count > 1).sum())
    both, columns = np.zeros((m, m), np.float32), min(4096, max(1, total))  # sums below 2^24 are exact
    for c in range(0, total, columns):
        s, e = np.searchsorted(column, (c, c + columns))
        x = np.zeros((m, columns), np.float32)
        x[owner[s:e], column[s:e] - c] = 1
        both += x @ x.T
    both = both.astype(np.int64)
    near = both * least.denominator >= least.numerator * (size[:, None] + size[None, :] - both)
    return np.nonzero(np.triu(near, 1))


def confirmed(rows: DataFrame, keys: list[str], width: int, least: Fraction) -> DataFrame:
    """A spanning forest (a, b) of the links between the rows(*keys, digest, text) of each group: all pairs are compared."""

    def run(group):
        import pyarrow as pa

        digest, at = np.unique(group.column("digest").to_numpy(), return_index=True)
        sets = shingle_sets(text_bytes(group.column("text").combine_chunks().take(pa.array(at))), width)
        parent = np.arange(len(digest))
        i, j = alike(sets, least)
        join_forest(parent, i, j)
        root = _roots(parent, np.arange(len(digest)))
        child = root != np.arange(len(digest))
        return pa.table({"a": digest[child], "b": digest[root[child]]})

    spark = rows.sparkSession
    n = max(parts(spark), 4 * spark.sparkContext.defaultParallelism)
    return rows.select(*keys, "digest", "text").repartition(n, *keys).groupBy(*keys).applyInArrow(run, "a long, b long")


def _hubs(members: DataFrame) -> DataFrame:
    """(cluster, hub, blocks): of each cluster the member nearest to the majority of the members' first words, which is
    the original or the copy most like it, and the number of blocks to compare."""
    vote = [F.sum(F.shiftright("word", k).bitwiseAND(F.lit(1).cast("long"))).alias(f"v{k}") for k in range(64)]
    size = [F.count(F.lit(1)).alias("m"), F.sum("n").cast("long").alias("w")]
    votes = members.groupBy("cluster").agg(*vote, *size)
    bit = lambda k: F.when(F.col(f"v{k}") * 2 > F.col("m"), F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    major = bit(0)
    for k in range(1, 64):
        major = major.bitwiseOR(bit(k))
    blocks = F.ceil(F.greatest(F.col("m") / MEMBERS, F.col("w") / SHINGLES)).cast("long")
    votes = materialise(votes.select("cluster", major.alias("major"), blocks.alias("blocks")), "simhash-votes")
    near = members.join(votes, "cluster").select("cluster", "digest", "blocks", F.bit_count(F.col("word").bitwiseXOR(F.col("major"))).alias("d"))
    return near.groupBy("cluster").agg(F.min(F.struct("d", "digest"))["digest"].alias("hub"), F.first("blocks").alias("blocks"))


def keep_one_alike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """``docs`` without near duplicates: of each component of links between texts whose sets of ``width``-word shingles
    have a Jaccard similarity of ``least`` or more, the rows whose id is the smallest stay. Columns are unchanged.

    Candidates (see the module) make clusters. A cluster is compared block by block, each with the cluster's hub; then the
    members that are not in the hub's component are compared with all others. So every pair of a cluster is compared,
    or is in one component already. Texts without words are alike. Rows without an id all stay and link nothing. Of an id
    that is repeated with other texts each text counts by itself; equal rows stay or go together. An empty table
    gives an empty result. Column names of ``docs`` starting with ``__`` are reserved.
    """
    known = docs.where(F.col(id_col).isNotNull())
    rows = materialise(signatures(known, id_col, text_col, width), "simhash-rows")
    classes = rows.groupBy("digest").agg(F.min("id").alias("first"), F.min(F.struct("id", "text_hash")).alias("sample"), F.first("n").alias("n"), F.first("words").alias("words"))
    classes = materialise(classes, "simhash-class")
    clusters = components(materialise(candidates(classes), "simhash-candidates"), "simhash-cc").select(F.col("node").alias("digest"), F.col("root").alias("cluster"))
    members = classes.join(clusters, "digest").select("cluster", "digest", "n", F.get("words", F.lit(0)).alias("word"), "sample.id", "sample.text_hash")
    members = materialise(members, "simhash-members")
    hubs = materialise(_hubs(members), "simhash-hubs")
    own = known.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    needed = materialise(members.join(hubs, "cluster").drop("word"), "simhash-needed")  # texts are not shuffled if these are few
    held = own.join(beside(needed), ["id", "text_hash"]).select("cluster", "digest", "n", "hub", "blocks", "text").dropDuplicates(["cluster", "digest"])
    held = materialise(held, "simhash-texts")
    block = F.pmod(F.xxhash64("digest"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    spread = held.withColumn("block", F.explode(F.when(F.col("digest") == F.col("hub"), every).otherwise(F.array(block))))
    links = materialise(confirmed(spread, ["cluster", "block"], width, least), "simhash-links")
    if not hubs.where("blocks > 1").isEmpty():
        links = materialise(links.unionByName(_rest(held.where("blocks > 1"), links, width, least)), "simhash-links")
    roots = components(links, "simhash-cc").select(F.col("node").alias("digest"), "root")
    grouped = materialise(classes.join(roots, "digest", "left").select("digest", "first", F.coalesce("root", "digest").alias("root")), "simhash-grouped")
    smallest = materialise(grouped.groupBy("root").agg(F.min("first").alias("component")), "simhash-smallest")
    placed = materialise(grouped.join(smallest, "root").select("digest", "component"), "simhash-found")
    return _without(docs, rows.select("id", "text_hash", "digest").join(placed, "digest"), id_col, text_col)


def _rest(held: DataFrame, links: DataFrame, width: int, least: Fraction) -> DataFrame:
    """Links of the members that are not in the component of their cluster's hub, with all members of the cluster: pairs
    of blocks, of which the first is of such members."""
    roots = components(links, "simhash-cc").select(F.col("node").alias("digest"), "root")
    named = held.join(roots, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    main = named.where("digest = hub").select("cluster", F.col("root").alias("main"))
    named = named.join(main, "cluster").withColumn("apart", F.col("root") != F.col("main"))
    sizes = named.groupBy("cluster").agg(*(F.coalesce(F.expr(f"cast(ceil(greatest(count_if({c}) / {MEMBERS}, sum(if({c}, n, 0)) / {SHINGLES})) as long)"), F.lit(0)).alias(name) for c, name in (("apart", "b_apart"), ("not apart", "b_main"))))
    named = materialise(named.join(sizes.where("b_apart > 0"), "cluster").select("cluster", "digest", "apart", "b_apart", "b_main", "text"), "simhash-rest")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    block = F.pmod(F.xxhash64("digest", F.lit(1)), F.when(F.col("apart"), F.col("b_apart")).otherwise(F.col("b_main")))
    # blocks of members apart are 0 to b_apart - 1, those of the others follow
    with_main = F.transform(F.when(F.col("b_main") > 0, upto(F.col("b_main"))).otherwise(F.array().cast("array<long>")), lambda j: pair(block, F.col("b_apart") + j))
    with_apart = F.transform(upto(F.col("b_apart")), lambda j: pair(F.least(block, j), F.greatest(block, j)))
    from_main = F.transform(upto(F.col("b_apart")), lambda i: pair(i, F.col("b_apart") + block))
    spread = named.withColumn("pair", F.explode(F.when(F.col("apart"), F.concat(with_apart, with_main)).otherwise(from_main)))
    return confirmed(spread.select("cluster", "pair.i", "pair.j", "digest", "text"), ["cluster", "i", "j"], width, least)
