import random

from hypothesis import given
from hypothesis import strategies as st

from graphloom.llm import decontam, queries
from graphloom.llm.common import table

words = st.lists(st.integers(0, 5), max_size=40)


@given(words, words)
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    assert decontam.common_subsequence(a, b) == row[-1]


def test_words():
    texts = ["Hello, wörld hello", "", "  ", "a" * 100 + " b"]
    hashes, bounds, ends = decontam.tokens([t.encode() for t in texts])
    assert bounds.tolist() == [0, 3, 3, 3, 5] and hashes[0] == hashes[2] and len(set(hashes.tolist())) == 4
    assert len(ends) == 5


def windows(tokens, size):
    return [tokens[k : k + size] for k in range(max(1, len(tokens) - size + 1))]


def brute(docs, items, full=0.7, part=0.5, answer=0.8):
    """Leaks by checking every item at every window of every document."""
    out = set()
    for d, text in docs:
        own = decontam.tokens([(text or "").encode()])[0].tolist()
        for i, t in items:
            raw = (t or "").encode()
            hashes, _, ends = decontam.tokens([raw])
            if len(hashes) < decontam.LEAST:
                continue
            span = decontam.answer_span(raw, ends)
            for w in windows(own, 2 * len(hashes) + 2 * decontam.STRIDE):
                share, tail = decontam.check(hashes.tolist(), span, w, part)
                if share >= full or (share >= part and tail >= answer):
                    out.add((d, i))
                    break
    return out


def test_query_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf, "benchmark").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in queries.op1_decontam(spark, sf).collect()}
    assert got and got == brute(docs, items)


def test_paraphrases_and_clean_documents(spark, sf):
    rng = random.Random(6)
    corpus = [r["text"] or "" for r in table(spark, sf, "documents").collect()]
    pool = sorted({w for t in corpus for w in t.split()})
    own = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, own(rng.randint(25, 50)) + ". " + own(6) + ".") for k in range(20)]
    docs = []
    for k, t in items:
        w = t.split()
        for at in rng.sample(range(len(w) - 8), len(w) // 6):  # a sixth of the words before the answer
            w[at] = rng.choice(pool)
        docs.append((k, f"{own(rng.randint(0, 120))} {' '.join(w)} {own(rng.randint(0, 120))}"))
    docs += [(1000 + k, t) for k, t in enumerate(corpus)]
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["id"], r["item_id"]) for r in found.collect()} == {(k, k) for k in range(20)}


def test_blocks_of_items(spark, sf, monkeypatch):
    whole = queries.op1_decontam(spark, sf).select("doc_id", "item_id").collect()
    monkeypatch.setattr(decontam, "ITEMS", 17)
    assert sorted(whole) == sorted(queries.op1_decontam(spark, sf).select("doc_id", "item_id").collect())


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "a b"), (4, " ".join(f"shared{k} word{k * 7 % 13}" for k in range(15)))], "item_id long, text string")
    found = decontam.leaks(odd, items).collect()
    assert sorted((r["id"], r["item_id"]) for r in found) == [(8, 4), (9, 4), (9, 4)]
    kept = decontam.drop_leaks(odd, items)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, 7, None, None]))
    assert decontam.drop_leaks(odd, items.limit(0)).count() == odd.count()
    assert decontam.leaks(none, items).count() == 0 and decontam.drop_leaks(none, items).count() == 0


def test_hot_items_and_half_paraphrases_against_brute_force(spark, sf):
    """Items in a third of the documents, and leaks of half of an item's words and its whole answer."""
    rng = random.Random(8)
    corpus = [r["text"] or "" for r in table(spark, sf, "documents").collect()]
    pool = sorted({w for t in corpus for w in t.split()})
    own = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    hot = [own(14) + ".", own(19) + "."]
    items = [*enumerate(hot), *((10 + k, own(rng.randint(8, 44)) + ". " + own(rng.randint(4, 6)) + ".") for k in range(30))]
    docs = [(k, t + (f" {hot[k % 2]} {own(rng.randint(5, 60))}" if k % 3 == 0 else "")) for k, t in enumerate(corpus)]
    for k in range(60):  # 78 % of a hot item's words
        some = [w if rng.random() < 0.78 else rng.choice(pool) for w in hot[k % 2].split()]
        docs.append((1000 + k, f"{own(rng.randint(5, 60))} {' '.join(some)} {own(rng.randint(5, 60))}"))
    for k, t in items[2:]:
        head, _, tail = t.rpartition(". ")
        w = head.split()
        for at in rng.sample(range(len(w)), (len(w) + len(tail.split())) // 2 - 1):
            w[at] = rng.choice(pool)
        docs.append((2000 + k, f"{own(rng.randint(20, 60))} {' '.join(w)} {tail} {own(rng.randint(20, 60))}"))
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["id"], r["item_id"]) for r in found.collect()}
    want = brute(docs, items)
    assert len({d for d, _ in want if d >= 2000}) >= 15 and got == want


def test_results_do_not_depend_on_the_layout(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    two, nine = (sorted(map(str, decontam.leaks(docs.repartition(n, "n_chars"), items).collect())) for n in (2, 9))
    assert two and two == nine


def test_long_items_against_brute_force(spark, sf):
    """Items of 60 to 500 words, kept whole, with a sixth of the words changed, or by half and with the answer."""
    rng = random.Random(15)
    corpus = [r["text"] or "" for r in table(spark, sf, "documents").limit(40).collect()]
    pool = sorted({w for t in corpus for w in t.split()})
    own = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(k, own(rng.choice([60, 130, 250, 500])) + ". " + own(6) + ".") for k in range(16)]
    docs = [(100 + k, t) for k, t in enumerate(corpus)]
    for k, t in items:
        w = t.split()
        for at in rng.sample(range(len(w) - 7), [0, len(w) // 6, len(w) * 45 // 100, len(w) * 6 // 10][k % 4]):
            w[at] = rng.choice(pool)
        docs.append((k, f"{own(rng.randint(0, 300))} {' '.join(w)} {own(rng.randint(0, 300))}"))
    found = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r["id"], r["item_id"]) for r in found.collect()}
    assert got == brute(docs, items) and {(k, k) for k in range(16) if k % 4 < 3} <= got


def test_size_of_what_is_broadcast():
    """It follows the bytes of a block's items, and the table of counts has a fixed number of rows."""
    import pickle

    rng = random.Random(3)
    for n in (50, 100):
        items = decontam.prepare([(k, " ".join(f"w{rng.randrange(9999)}" for _ in range(600))) for k in range(n)])
        counts = sum(c.nbytes for _, _, c in items.groups)
        assert counts == decontam.TERMS * n * 2 and len(pickle.dumps(items)) < counts + 16 * 600 * n
