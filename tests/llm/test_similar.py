import random

import corpus_pipeline
from graphloom.llm import simhash
from graphloom.llm.common import table


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def kept(rows):
    """Ids that stay, by brute force over all pairs."""
    sets, label = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    root = lambda i: i if label[i] == i else root(label[i])
    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and len(a & b) * 5 >= len(a | b) * 4:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [i for i in ids if root(i) == i]


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_stage_against_brute_force_jaccard(spark, sf):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    rows = []
    for _ in range(60):
        own = [word() for _ in range(rng.randint(60, 400))]
        rows.append((len(rows), " ".join(own)))
        for changed in (0.005, 0.012, 0.02, 0.03, 0.05):
            copy = [word() if rng.random() < changed else w for w in own]
            rows.append((len(rows), " \n".join(copy).upper()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = kept(rows)
    assert len(want) < 250
    assert ids(corpus_pipeline.one_of_each_group(spark, docs, sf)) == want


def test_documents_against_brute_force_jaccard(spark, sf):
    docs = table(spark, sf, "documents")
    assert ids(simhash.keep_one_alike(docs)) == kept([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])


def test_odd_rows(spark, odd, none):
    out = simhash.keep_one_alike(odd)
    assert out.columns == odd.columns and simhash.keep_one_alike(none).count() == 0
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(["1", "2", "6", "7", "8", "None", "None"])


def test_repeated_ids_with_other_texts(spark):
    """Only the text that is a copy goes; the other text of its id is its component's only row."""
    a, b = "one two three four five six seven", "other words that stand here for a text"
    docs = spark.createDataFrame([(9, a), (3, b), (9, b), (9, a)], "doc_id long, text string")
    for keep in (simhash.keep_one, simhash.keep_one_alike):
        assert sorted(tuple(r) for r in keep(docs).collect()) == [(3, b), (9, a), (9, a)]


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    """One group of many unlike copies of one text, compared in blocks, gives the components of all pairs."""
    monkeypatch.setattr(simhash, "MEMBERS", 16)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    own = [word() for _ in range(150)]
    rows = [(i, " ".join(word() if rng.random() < 0.03 else w for w in own)) for i in range(300)]
    want = kept(rows)
    assert 1 < len(want) < 200
    assert ids(simhash.keep_one_alike(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_dense_subtrees_are_split(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = sorted({b ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (2**64 - 1) for b in base for _ in range(12)})
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long").repartition(3)
    label = {v: v for v in values}
    root = lambda v: v if label[v] == v else root(label[v])
    for k, v in enumerate(values):
        for u in values[:k]:
            if (u ^ v).bit_count() <= 4:
                x, y = sorted((root(u), root(v)))
                label[y] = x

    def groups(links):
        out = {signed(v): signed(v) for v in values}
        up = lambda v: v if out[v] == v else up(out[v])
        for a, b in links:
            x, y = sorted((up(a), up(b)))
            out[y] = x
        return {frozenset(v for v in out if up(v) == r) for r in {up(v) for v in out}}

    want = {frozenset(signed(v) for v in values if root(v) == r) for r in {root(v) for v in values}}
    assert groups(tuple(r) for r in simhash.linked(fps).collect()) == want
    monkeypatch.setattr(simhash, "DENSE", 3)
    assert groups(tuple(r) for r in simhash.linked(fps).collect()) == want
