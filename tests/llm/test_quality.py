import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import quality, queries
from graphloom.llm.common import table


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents").select("doc_id", "text", "source", "lang"), table(spark, sf, "labels").distinct()
    half = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(2)) == 0
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    judged = quality.classify(docs, labels.where(half)).join(labels.where(~half).withColumnRenamed("doc_id", "id"), "id").toPandas()
    clean, bad = judged[(judged.quality == 1) & (judged.toxic == 0)], judged[judged.quality == 0]
    assert len(judged) > 1500 and clean.keep.mean() > 0.99 and bad.keep.mean() < 0.03
    toxic = judged[judged.toxic == 1]
    assert toxic.keep.mean() < 0.3


def test_features_of_each_text_alone():
    texts = [b"", b"Hello WORLD again again!", "Ärger | über | alles.\nund\n".encode(), b" ", b"x" * 3000]
    together = quality.features(texts)
    for k, t in enumerate(texts):
        alone = quality.features([t])
        assert np.allclose(together.dense[k], alone.dense[0]), k
        assert sorted(together.word[together.doc == k]) == sorted(alone.word)
    assert not together.dense[0].any()


def test_posteriors_shrink(spark):
    rows = [("a", "x", 0.9)] * 200 + [("a", "y", 0.1)] * 200 + [("b", "x", 0.5)] * 300 + [("c", None, 0.0)] + [(None, "x", 1.0)] * 2
    out = {(r["site"], r["path"]): r for r in quality.posteriors(spark.createDataFrame(rows, "site string, path string, p double")).collect()}
    prior = sum(r[2] for r in rows) / len(rows)
    assert all(abs(r["prior"] - prior) < 1e-12 for r in out.values()) and len(out) == 5
    assert out["a", "x"]["path_posterior"] > 0.85 and out["a", "y"]["path_posterior"] < 0.15
    lone = out["c", None]
    assert 0 < lone["site_posterior"] < prior and lone["path_posterior"] < lone["site_posterior"]


def test_sample_bound(spark, sf):
    heads = quality.fit(table(spark, sf, "documents"), table(spark, sf, "labels"), sample=10)
    assert all(h is None or len(h.words) == 0 for h in heads)


def test_query_keeps_good_documents(spark, sf):
    kept = {r["doc_id"] for r in queries.op6_quality(spark, sf).collect()}
    truth = table(spark, sf, "labels").toPandas()
    good = truth[(truth.quality == 1) & (truth.toxic == 0)].doc_id
    assert good.isin(kept).mean() > 0.95 and truth[truth.quality == 0].doc_id.isin(kept).mean() < 0.2


@pytest.mark.parametrize("with_labels", [True, False])
def test_odd_rows(spark, odd, none, with_labels):
    labels = [(1, 1, 0), (6, 0, 1), (7, None, None), (None, 1, 1), (8, 1, None), (8, 1, None)] if with_labels else []
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = quality.classify(odd, labels)
    assert out.count() == odd.count() and out.where("keep is null or p_good is null").count() == 0
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert sorted(str(r["id"]) for r in out.where("keep").collect()) == sorted(str(r["doc_id"]) for r in kept.collect())
    if not with_labels:
        assert kept.count() == odd.count()
    assert quality.keep_good(none, labels).count() == 0 and quality.classify(none, labels).count() == 0


def test_sample_is_a_bound_for_repeated_ids(spark):
    """5,000 rows of one id are one example, so ten labels give at most ten rows."""
    docs = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("some text "), "id").alias("text"))
    docs = docs.unionByName(spark.range(2, 40).select(F.col("id").alias("doc_id"), F.lit("a few other words here").alias("text")))
    labels = spark.range(40).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    rows, fit_head = [], quality.fit_head

    def watched(dense, *rest):
        rows.append(len(dense))
        return fit_head(dense, *rest)

    quality.fit_head = watched
    try:
        heads = quality.fit(docs, labels, sample=12)
    finally:
        quality.fit_head = fit_head
    assert rows and max(rows) <= 12 and heads[1] is None


def test_posteriors_against_plain_python(spark):
    """Both levels of shrinkage, worked out in plain Python, and the decision of each document."""
    rng = np.random.default_rng(4)
    rows = [(f"s{int(rng.integers(0, 6))}", f"p{int(rng.integers(0, 3))}", float(rng.beta(2, 2)), float(rng.normal())) for _ in range(500)] + [("lone", "p0", 0.2, 3.0)]
    got = {(r["site"], r["path"]): r for r in quality.posteriors(spark.createDataFrame(rows, "site string, path string, p double, t double")).collect()}
    prior = sum(r[2] for r in rows) / len(rows)

    def groups(key):
        out = {}
        for r in rows:
            n, s = out.get(key(r), (0, 0.0))
            out[key(r)] = n + 1, s + r[2]
        return out

    def weight(own, centre):
        own = {k: v for k, v in own.items() if v[0] > 1}
        total = sum(n for n, _ in own.values())
        spread = sum(n * (s / n - centre(k)) ** 2 for k, (n, s) in own.items()) / total
        noise = sum(centre(k) * (1 - centre(k)) for k in own) / total
        level = sum(centre(k) * (1 - centre(k)) for k in own) / len(own)
        return min(max(level / max(spread - noise, 1e-6) - 1, 1.0), 1000.0)

    sites, paths = groups(lambda r: r[0]), groups(lambda r: r[:2])
    k = weight(sites, lambda _: prior)
    site = {i: (s + k * prior) / (n + k) for i, (n, s) in sites.items()}
    k = weight(paths, lambda i: site[i[0]])
    assert set(got) == set(paths)
    for i, (n, s) in paths.items():
        assert abs(got[i]["site_posterior"] - site[i[0]]) < 1e-9 and abs(got[i]["path_posterior"] - (s + k * site[i[0]]) / (n + k)) < 1e-9

    scored = spark.createDataFrame([(i, s, p, float(np.log(x / (1 - x))), t) for i, (s, p, x, t) in enumerate(rows)], "id long, site string, path string, good double, poison double")
    judged = quality._judged(scored, quality._groups(scored), 0.5, 0.5, 0.3)
    odds = lambda x: np.log(min(max(x, 1e-3), 1 - 1e-3) / (1 - min(max(x, 1e-3), 1 - 1e-3)))
    for r in judged.collect():
        s, p, x, t = rows[r["id"]]
        n, total = paths[s, p]
        z = np.log(x / (1 - x)) + 0.5 * (odds((total + k * site[s]) / (n + k)) - odds(prior))
        assert abs(r["p_good"] - 1 / (1 + np.exp(-z))) < 1e-9 and r["keep"] == (1 / (1 + np.exp(-z)) >= 0.5 and 1 / (1 + np.exp(-t)) < 0.3)
