import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import queries, substring
from graphloom.llm.common import table


def rolled(data: bytes) -> list[int]:
    """Boundaries by the definition, byte by byte."""
    h, hashes = 0, []
    for b in data:
        h = ((h << 1) + int(substring.GEAR[b])) & 0xFFFF
        hashes.append(h)
    ends, chain, last = [], 0, None
    for k, h in enumerate(hashes):
        if h == min(hashes[max(0, k - substring.REACH) : k + substring.REACH + 1]):
            if last is None or k - last > substring.REACH:
                chain = k
                ends.append(k + 1)
            elif (k - chain) // substring.TIES != (last - chain) // substring.TIES:
                ends.append(k + 1)
            last = k
    if data and (not ends or ends[-1] != len(data)):
        ends.append(len(data))
    return ends


@settings(deadline=None)
@given(st.binary(max_size=3000))
def test_boundaries(data):
    assert substring.boundaries(np.frombuffer(data, np.uint8)).tolist() == rolled(data)


def test_boundaries_of_degenerate_texts():
    for data in (b"", b"a" * 5000, b"ab" * 3000, bytes(1000)):
        assert substring.boundaries(np.frombuffer(data, np.uint8)).tolist() == rolled(data)


def test_boundaries_resist_shifts():
    rng = random.Random(1)
    text = bytes(rng.randrange(97, 123) for _ in range(5000))
    a = {text[s:e] for s, e in zip([0, *rolled(text)], rolled(text))}  # noqa: B905
    moved = b"some words put in front, " + text[:2500] + b"!" + text[2500:]
    b = {moved[s:e] for s, e in zip([0, *rolled(moved)], rolled(moved))}  # noqa: B905
    assert len(a - b) <= 6


def test_equal_spans_are_whole_words():
    here, there = b"xx one two three four yy", b"zz one two three four qq"
    assert substring.equal_spans(here, there, 3, b"") == [(3, 18, 4)]
    assert substring.equal_spans(b"lead one two three", b"tead one two three", 3, b"") == [(5, 13, 3)]
    assert substring.equal_spans(b"one two\nthree", b"one\ttwo three", 3, b"") == [(0, 13, 3)]
    assert substring.equal_spans(b"one two three", b"one two three", 3, b"x") == []
    assert substring.equal_spans(b"one two three", b"one two three", 3, b" ") == [(0, 13, 3)]


def longest_common_words(a: str, b: str) -> int:
    x, y = a.split(), b.split()
    best, row = 0, [0] * (len(y) + 1)
    for w in x:
        new = [0] * (len(y) + 1)
        for k, v in enumerate(y):
            if w == v:
                new[k + 1] = row[k] + 1
                best = max(best, new[k + 1])
        row = new
    return best


def test_query_against_brute_force(spark, sf):
    """Every pair of documents with an exact passage of 50 words or more is found, nothing else."""
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    grams = {}
    for i, t in texts.items():
        w = t.split()
        for k in range(len(w) - 49):
            grams.setdefault(" ".join(w[k : k + 50]), set()).add(i)
    surely = {i for ids in grams.values() if len(ids) > 1 for i in ids if i != min(ids)}
    rows = queries.op9_substring(spark, sf).collect()
    assert surely <= {r["doc_id"] for r in rows}
    for r in rows:
        raw = texts[r["doc_id"]].encode()[r["start"] : r["start"] + r["length"]]
        assert r["first_doc_id"] < r["doc_id"] and raw.decode()
        if len(raw.split()) == r["words"]:  # not merged from several
            assert raw.translate(substring.FLAT) in texts[r["first_doc_id"]].encode().translate(substring.FLAT)


def test_planted_passage(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9)))
    own = lambda n: " ".join(word() for _ in range(n))
    passage = own(51)
    rows = [(i, f"{own(rng.randint(5, 90))} {passage} {own(rng.randint(5, 90))}") for i in range(40)] + [(100 + i, own(150)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring.repeats(docs).collect()
    assert sorted(r["id"] for r in found) == list(range(1, 40)) and {r["first_id"] for r in found} == {0}
    left = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs).collect()}
    texts = dict(rows)
    assert all(left[i] == texts[i] for i in (0, *range(100, 140)))
    assert all(left[i] == texts[i].replace(passage, "") for i in range(1, 40))


def test_odd_rows(spark, odd, none):
    out = substring.remove_repeats(odd, min_words=20)
    assert out.columns == odd.columns and out.count() == odd.count()
    found = substring.repeats(odd, min_words=20).collect()
    assert {r["id"] for r in found} == {9} and {r["first_id"] for r in found} == {8}
    before = sorted(str(r) for r in odd.where("doc_id is null or doc_id <> 9").collect())
    assert sorted(str(r) for r in out.where("doc_id is null or doc_id <> 9").collect()) == before
    assert {r["text"] for r in out.where("doc_id = 9").collect()} == {"other begin of text  and some other tail"}
    assert substring.remove_repeats(none).count() == 0


def test_every_copy_of_a_passage(spark):
    """A later document holds the passage three times; another has its chunks in another order before it."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    own = lambda n: " ".join(word() for _ in range(n))
    passage = own(60)
    w = passage.split()
    parts = " ".join(f"{' '.join(w[k : k + 20])} {own(3)}" for k in range(45, -1, -5))
    rows = [(0, f"{own(30)} {passage} {own(20)}"), (1, f"{own(9)} {passage} {own(70)} {passage} {own(40)} {passage} {own(5)}"), (2, f"{parts} {own(50)} {passage} {own(7)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs).collect()}
    assert left == {i: t.replace(passage, "") if i else t for i, t in rows}


def test_passages_longer_than_the_window(spark):
    """The passage's chunks but a few are held by earlier documents that lack the passage."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    own = lambda n: " ".join(word() for _ in range(n))
    passage = own(2000)
    w = passage.split()
    lines = [(k // 40, " ".join(w[k : k + 40])) for k in range(0, 2000, 40) if k != 1000]
    rows = [(i, f"{own(5)} {x} {own(5)}") for i, x in lines] + [(100 + i, f"{own(5)} {x} {own(5)}") for i, x in lines]
    rows += [(200, f"{own(30)} {passage} {own(20)}"), (201, f"{own(9)} {passage} {own(70)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in substring.remove_repeats(docs).collect()}
    assert left == {i: t.replace(passage, "") if i == 201 else t for i, t in rows}
