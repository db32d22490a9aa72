import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import queries, simhash
from graphloom.llm.common import components, table


def plain(text: bytes) -> int:
    words = text.lower().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def grouped(ids, fps):
    """Smallest id of each row's component, by brute force."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 4 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    known = lambda k: [i for i, x in zip(ids, label, strict=True) if x == k and i is not None]
    return [min(known(x), default=None) for x in label]


@given(st.text(alphabet="aAbBé \n\t\x0b\x1c,ß", max_size=300))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain(text.encode())


def test_fingerprint_of_many_shingles():
    text = " ".join(str(k * k % 997) for k in range(70_000)).encode()
    assert simhash.fingerprint(text) == plain(text)


@settings(deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=40, unique=True), st.data())
def test_trie_links(seeds, data):
    near = [s ^ (1 << data.draw(st.integers(0, 63))) ^ (1 << data.draw(st.integers(0, 63))) for s in seeds[: len(seeds) // 2]]
    values = np.unique(np.array([*seeds, *near], np.uint64))
    trie = simhash.Trie(values)
    got = sorted((int(a), int(b)) for i, j in simhash.trie_links(trie, trie, 4) for a, b in zip(i, j, strict=True))
    want = [(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 4]
    assert got == want
    other = simhash.Trie(np.unique(values ^ np.uint64(5)))
    pairs = {(int(a), int(b)) for i, j in simhash.trie_links(trie, other, 4) for a, b in zip(i, j, strict=True)}
    assert pairs == {(i, j) for i, x in enumerate(values) for j, y in enumerate(other.values) if (int(x) ^ int(y)).bit_count() <= 4}


def test_small_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    values = np.unique(np.random.default_rng(1).integers(0, 64, 40).astype(np.uint64))
    trie = simhash.Trie(values)
    assert sum(len(i) for i, _ in simhash.trie_links(trie, trie, 4)) == sum((int(a) ^ int(b)).bit_count() <= 4 for k, a in enumerate(values) for b in values[:k])


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (103, 101), (7, 7), (None, 3), (200, 100)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(61)} == {0} and {got[k] for k in (100, 101, 103, 200)} == {100} and len(got) == 65


def test_query_against_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in queries.op2_simhash(spark, sf).collect()}
    rows = table(spark, sf, "documents").select("doc_id", "text").collect()
    fps = [plain((r["text"] or "").encode()) for r in rows]
    want = grouped([r["doc_id"] for r in rows], fps)
    for r, fp, c in zip(rows, fps, want, strict=True):
        assert got[r["doc_id"]]["fingerprint"] == f"{fp:016x}" and got[r["doc_id"]]["component_id"] == c


def test_odd_rows(spark, odd):
    got = sorted((str(r["id"]), r["fp"], r["component"]) for r in simhash.near_duplicates(odd).collect())
    rows = odd.select("doc_id", "text").collect()
    fps = [plain((r["text"] or "").encode()) for r in rows]
    want = grouped([r["doc_id"] for r in rows], fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    assert got == sorted((str(r["doc_id"]), f, c) for r, f, c in zip(rows, signed, want, strict=True))


def test_keep_one(spark, odd, none):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "6", "7", "8", "9", "9", "None", "None"])
    assert simhash.keep_one(none).count() == 0 and simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("p", [4])
def test_large_group_of_near_copies(spark, p):
    base = np.uint64(0xABCDEF0123456789)
    values = sorted({int((base ^ np.uint64((1 << a) | (1 << b))).view(np.int64)) for a in range(40) for b in range(a)})
    links = simhash.linked(spark.createDataFrame([(v,) for v in values], "fp long"))
    assert {r["root"] for r in components(links).collect()} == {min(values)}
    assert links.count() <= 16 * len(values)
