"""Quality classifier: document evidence with hierarchical empirical Bayes over sites and paths.

Two logistic heads (low quality, toxic) are fit on a bounded sample of labelled rows (at most ``sample``, chosen by
hash). Their features are counts of a text's make-up (cases, symbols, repetition, lengths) and the presence of those
hashed words that the sample shows to matter. Every document is scored whole.

The probabilities of being good are then aggregated by site and by path within a site, and shrunk: a path's posterior
toward its site's, a site's toward the global mean, by the weight of evidence that the spread between groups suggests
(method of moments). A document's log odds move by ``site_weight`` times the path posterior's log odds against the
global ones. Sparse sites stay at the global prior. Both levels are plain group-bys with map-side combining.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import WORD, materialise, slices, text_bytes, word_hashes, word_spans

SAMPLE = 12_288  # labelled rows used to fit, at most
WORDS = 512  # hashed words that a head looks at
DENSE = 16
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALPHA = _UPPER.copy()
_ALPHA[97:123] = True
_ALPHA[128:] = True
_MARK = np.zeros(256, bool)
_MARK[[c for c in range(33, 127) if not WORD[c] and chr(c) not in ".,;:'\"()-?"]] = True
BATCH = 1 << 21  # bytes handled at a time


@dataclass
class Features:
    dense: np.ndarray  # (n, DENSE)
    doc: np.ndarray  # the distinct words of each text, as (text number, 20-bit hash) pairs
    word: np.ndarray


def features(texts: list[bytes]) -> Features:
    """Features of whole texts; those of an empty text are zeros."""
    n = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, n)
    first = np.cumsum(size + 1) - size - 1

    def share(flags: np.ndarray) -> np.ndarray:
        return np.add.reduceat(flags, first, dtype=np.int64)

    starts, ends = word_spans(data)
    owner = np.searchsorted(first, starts, "right") - 1
    h = word_hashes(data, starts, ends)
    words = np.bincount(owner, minlength=n)
    letters, upper, marks = share(_ALPHA[data]), share(_UPPER[data]), share(_MARK[data])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    tagged = _MARK[data[np.minimum(ends, len(data) - 1)]]  # a symbol right behind the word
    shouted = (_UPPER[data[starts]] & _UPPER[data[ends - 1]] & (ends - starts > 1)) if len(starts) else np.zeros(0, bool)
    key = (owner.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32))
    key.sort()
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    distinct = key[fresh]
    doc = (distinct >> np.uint64(32)).astype(np.int64)
    kinds = np.bincount(doc, minlength=n)
    runs = np.diff(np.append(np.flatnonzero(fresh), len(key)))
    top = np.zeros(n, np.int64)
    np.maximum.at(top, doc, runs)
    length = np.bincount(owner, ends - starts, n)
    per, w = np.maximum(size, 1), np.maximum(words, 1)
    count = lambda c: share(data == ord(c)) - (c == "\n")  # noqa: E731  the separator is not the text's
    dense = np.stack(
        [
            np.log1p(size), np.log1p(words), upper / np.maximum(letters, 1), marks / per, share((data >= 48) & (data < 58)) / per, count("\n") / per,
            length / w, kinds / w, np.log1p(kinds) / np.log1p(w), np.bincount(owner, again, n) / w, np.bincount(owner, tagged, n) / w,
            np.bincount(owner, shouted, n) / w, top / w, count("!") / per, count("|") / per, count(".") / w,
        ], 1,
    )
    return Features(dense * (size > 0)[:, None], doc, (distinct & np.uint64(0xFFFFF)).astype(np.int64))


@dataclass
class Head:
    """A logistic model over standardised dense features and the presence of chosen words."""

    mean: np.ndarray
    scale: np.ndarray
    words: np.ndarray  # chosen 20-bit hashes
    weights: np.ndarray  # dense, words, bias

    def design(self, f: Features, n: int) -> np.ndarray:
        slot = np.full(1 << 20, -1, np.int32)
        slot[self.words] = np.arange(len(self.words))
        at = slot[f.word]
        x = np.zeros((n, DENSE + len(self.words) + 1), np.float32)
        x[:, :DENSE] = (f.dense - self.mean) / self.scale
        x[f.doc[at >= 0], DENSE + at[at >= 0]] = 1
        x[:, -1] = 1
        return x

    def logit(self, f: Features, n: int) -> np.ndarray:
        return self.design(f, n) @ self.weights


def fit_head(dense: np.ndarray, doc: np.ndarray, word: np.ndarray, chosen: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Head:
    """Newton steps on the ridge logistic loss, over dense features and the presence of the ``chosen`` words: text doc[k] has
    the word word[k]."""
    n, f = len(y), Features(dense, doc, word)
    scale = dense.std(0)
    head = Head(dense.mean(0), np.where(scale > 1e-9, scale, 1), chosen, np.zeros(0))
    x = head.design(f, n)
    np.clip(x[:, :DENSE], -8, 8, out=x[:, :DENSE])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(12):
        gradient, hessian = penalty * w, np.diag(penalty)
        for at in range(0, n, 2048):  # a block of rows in double precision at a time
            own = x[at : at + 2048].astype(np.float64)
            q = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            gradient += own.T @ (q - y[at : at + 2048])
            hessian += (own * (q * (1 - q))[:, None]).T @ own
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    head.weights = w.astype(np.float32)
    return head


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 5, id_col: str = "doc_id", text_col: str = "text") -> tuple[Head | None, Head | None]:
    """(bad, toxic) heads from at most ``sample`` labelled rows, those of smallest hash. A head without examples of both
    kinds is None; a null label of a kind is no example for its head. Of an id that is repeated in ``docs`` the smallest
    text counts. The driver gets at most ``sample`` rows of DENSE numbers and of WORDS words."""
    chosen = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("id is not null")
    chosen = chosen.distinct().orderBy(F.xxhash64("id", F.lit(seed)), "id", "quality", "toxic").limit(sample)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # bounded by `sample`, also where ids are repeated: one text each
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "quality", "toxic").agg(F.min("text").alias("text"))

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            for lo, hi in _blocks(texts := text_bytes(b.column(1))):
                f = features(texts[lo:hi])
                cut = np.searchsorted(f.doc, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo), b.column(2).slice(lo, hi - lo), b.column(3).slice(lo, hi - lo),
                        pa.array(list(f.dense)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(f.word.astype(np.int32))),
                    ],
                    ["id", "quality", "toxic", "dense", "words"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.select("id", "text", "quality", "toxic").mapInArrow(run, f"id {kind}, quality int, toxic int, dense array<double>, words array<int>")
    made = materialise(made, "quality-sample")
    heads = []
    for column, bad in (("quality", 0), ("toxic", 1)):
        own = made.where(F.col(column).isNotNull()).withColumn("y", (F.col(column) == bad).cast("double"))
        n, p = own.agg(F.count(F.lit(1)), F.avg("y")).first()
        if not n or p in (0.0, 1.0):
            heads.append(None)
            continue
        # words are counted in the executors; the driver gets the WORDS that matter most, by association with the label
        counts = own.select("y", F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("seen"), F.sum("y").alias("hits")).where("seen >= 4")
        strength = F.abs(F.col("hits") - F.col("seen") * p) / F.sqrt(F.col("seen") * p * (1 - p) + 1e-9)
        top = counts.withColumn("s", strength).where("s > 4").orderBy(F.desc("s"), "w").limit(WORDS).select("w").collect()
        chosen = sorted(r["w"] for r in top)
        kept = F.array_intersect("words", F.lit(chosen).cast("array<int>")) if chosen else F.array().cast("array<int>")
        table = own.select("id", "quality", "toxic", "y", "dense", kept.alias("words")).orderBy("id", "quality", "toxic").toArrow()
        words = table.column("words").to_pylist()
        doc = np.repeat(np.arange(n), list(map(len, words)))
        word = np.array([w for own_words in words for w in own_words], np.int64)
        dense = table.column("dense").combine_chunks().flatten().to_numpy().reshape(-1, DENSE)
        heads.append(fit_head(dense, doc, word, np.array(chosen, np.int64), table.column("y").to_numpy()))
    return heads[0], heads[1]


def _blocks(texts: list[bytes]) -> list[tuple[int, int]]:
    out, lo, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= BATCH or k == len(texts) - 1:
            out.append((lo, k + 1))
            lo, size = k + 1, 0
    return out


def evidence(rows: DataFrame, heads: tuple[Head | None, Head | None], texts, drop: int = 0) -> DataFrame:
    """``rows`` with good (log odds of good quality) and poison (log odds of toxic), without the last ``drop`` columns.
    ``texts(batch)`` gives the Arrow column of a batch that holds the texts. A head that is None gives good, and not
    toxic, at 4 to 1."""
    bad, toxic = heads
    kept = len(rows.columns) - drop

    def run(batches):
        import pyarrow as pa

        for b in slices(batches):
            own = text_bytes(texts(b))
            for lo, hi in _blocks(own):
                n, f = hi - lo, features(own[lo:hi])
                good = -bad.logit(f, n) if bad else np.full(n, np.log(4.0))
                poison = toxic.logit(f, n) if toxic else np.full(n, -np.log(4.0))
                made = [pa.array(np.clip(x, -20, 20).astype(np.float64)) for x in (good, poison)]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, n) for c in b.columns[:kept]), *made], [*b.schema.names[:kept], "good", "poison"])

    fields = [*rows.schema.fields[:kept], *(T.StructField(c, T.DoubleType()) for c in ("good", "poison"))]
    return rows.mapInArrow(run, T.StructType(fields))


def _odds(p):
    p = F.least(F.greatest(p, F.lit(1e-3)), F.lit(1 - 1e-3))
    return F.ln(p / (1 - p))


def posteriors(scored: DataFrame, site: str = "site", path: str = "path", p: str = "p") -> DataFrame:
    """(site, path, n_path, site_posterior, path_posterior, prior) for each path of scored(site, path, p).

    The global prior is the mean of p. A site's posterior is (sum of p + k prior) / (n + k), k by the method of moments
    from the variance between sites, 1 at least and 1000 at most; a path's posterior shrinks to its site's the same
    way with the variance between paths. Null sites and paths are groups like any other.
    """
    paths = scored.groupBy(site, path).agg(F.count(F.lit(1)).alias("n_path"), F.sum(p).alias("s_path"))
    paths = materialise(paths, "quality-paths")
    sites = paths.groupBy(site).agg(F.sum("n_path").alias("n_site"), F.sum("s_path").alias("s_site"))
    total = sites.agg((F.sum("s_site") / F.sum("n_site")).alias("prior")).where("prior is not null")

    def weight(groups: DataFrame, n: str, s: str, centre, name: str) -> DataFrame:
        many = groups.where(F.col(n) > 1)
        spread = F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - centre, 2)) / F.sum(n)
        noise = F.sum(centre * (1 - centre)) / F.sum(n)
        between = F.greatest(spread - noise, F.lit(1e-6))
        level = F.avg(centre * (1 - centre))
        return many.agg(F.coalesce(F.least(F.greatest(level / between - 1, F.lit(1.0)), F.lit(1000.0)), F.lit(1000.0)).alias(name))

    sites = sites.crossJoin(F.broadcast(total))
    sites = sites.crossJoin(F.broadcast(weight(sites, "n_site", "s_site", F.col("prior"), "k_site")))
    sites = sites.select(F.col(site).alias("__site"), "prior", ((F.col("s_site") + F.col("k_site") * F.col("prior")) / (F.col("n_site") + F.col("k_site"))).alias("site_posterior"))
    rows = paths.join(sites, F.col(site).eqNullSafe(F.col("__site"))).drop("__site")
    rows = rows.crossJoin(F.broadcast(weight(rows, "n_path", "s_path", F.col("site_posterior"), "k_path")))
    post = (F.col("s_path") + F.col("k_path") * F.col("site_posterior")) / (F.col("n_path") + F.col("k_path"))
    return rows.select(site, path, "n_path", "site_posterior", post.alias("path_posterior"), "prior")


def _judged(scored: DataFrame, groups: DataFrame, site_weight: float, threshold: float, most_toxic: float) -> DataFrame:
    """scored(site, path, good, poison, ...) with the columns of ``classify``. The groups are a plain table, which Spark
    broadcasts if it is small."""
    groups = groups.withColumnsRenamed({"site": "__site", "path": "__path"})
    rows = scored.join(groups, F.col("site").eqNullSafe(F.col("__site")) & F.col("path").eqNullSafe(F.col("__path")))
    odds = F.col("good") + site_weight * (_odds(F.col("path_posterior")) - _odds(F.col("prior")))
    sure = lambda x: 1 / (1 + F.exp(-x))
    rows = rows.withColumns({"p_doc": sure(F.col("good")), "p_good": sure(odds), "p_toxic": sure(F.col("poison"))})
    return rows.withColumn("keep", (F.col("p_good") >= threshold) & (F.col("p_toxic") < most_toxic))


def _groups(scored: DataFrame) -> DataFrame:
    return materialise(posteriors(scored.select("site", "path", (1 / (1 + F.exp(-F.col("good")))).alias("p"))), "quality-groups")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang", sample: int = SAMPLE, site_weight: float = 0.5, threshold: float = 0.5, most_toxic: float = 0.3) -> DataFrame:
    """(id, site, path, p_doc, site_posterior, path_posterior, p_good, p_toxic, keep): one row per row of ``docs``.

    keep: p_good is ``threshold`` at least and p_toxic below ``most_toxic``. Null and empty texts are scored on their (zero)
    features; null sites and paths form groups of their own; repeated rows are scored alike; without usable labels
    every document counts as good at 4 to 1; an empty table gives an empty result. Other columns are not read.
    """
    heads = fit(docs, labels, sample, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(site_col).cast("string").alias("site"), F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    scored = materialise(evidence(rows, heads, lambda b: b.column(3), drop=1), "quality-evidence")
    out = _judged(scored, _groups(scored), site_weight, threshold, most_toxic)
    return out.select("id", "site", "path", "p_doc", "site_posterior", "path_posterior", "p_good", "p_toxic", "keep")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang", sample: int = SAMPLE, site_weight: float = 0.5, threshold: float = 0.5, most_toxic: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, all columns unchanged. The texts are scored a second time beside
    their rows, which costs less than writing or shuffling them."""
    heads = fit(docs, labels, sample, id_col=id_col, text_col=text_col)
    groups = docs[site_col].cast("string").alias("site"), docs[path_col].cast("string").alias("path")
    first = docs.select(*groups, docs[text_col].cast("string").alias("text"))
    shrunk = _groups(materialise(evidence(first, heads, lambda b: b.column(2), drop=1), "quality-evidence"))
    at = docs.columns.index(text_col)
    rows = docs.select(*groups, F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    kept = _judged(evidence(rows, heads, lambda b: b.column(2).field(at)), shrunk, site_weight, threshold, most_toxic).where("keep")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))
