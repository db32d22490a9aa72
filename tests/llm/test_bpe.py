import hashlib
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import bpe, queries
from graphloom.llm.common import table

PATH = queries.vocabulary_path()


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


PIECES = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'re", "'", "r", "1", "23", "é", "ß", "漢", "!", "?", "<|endoftext|>", "<|end", "oftext|>", "\xa0", "　", "\x1c", "\x85", "👍", "é", "​", "_", "aaaa", "LL", "'ll", "'v", " '"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join) | st.text(max_size=80), st.sampled_from([(1 << 16, 1024), (7, 5), (1, 2), (3, 8)]))
def test_like_the_library(vocabulary, library, text, sizes):
    feed, long = bpe.FEED, bpe.LONG
    bpe.FEED, bpe.LONG = sizes
    try:
        ids = bpe.Encoder(vocabulary).encode(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == bpe.pack(want)
        assert bpe.Decoder(vocabulary).decode(ids, 8) == library.decode(want, skip_special_tokens=False)
    finally:
        bpe.FEED, bpe.LONG = feed, long


@pytest.mark.parametrize("unit", ["a", " ", "!", "1", "ab", "  \n", "漢", "th", "é"])
def test_long_runs(vocabulary, library, unit):
    encoder = bpe.Encoder(vocabulary)
    for text in (unit * 30_001, f"x {unit * 5000} y", unit * 5000 + "'s", f" {unit * 1100}"):
        assert encoder.encode(text) == bpe.pack(library.encode(text, add_special_tokens=False).ids)


def proper_list(rng, alphabet, n):
    known, merges = [bytes([c]) for c in alphabet], []
    for _ in range(n):
        a, b = rng.choice(known), rng.choice(known)
        if len(a + b) <= 12 and a + b not in known:
            merges.append((a, b))
            known.append(a + b)
    return merges, {t: k for k, t in enumerate(known)}


def test_lookahead_suffices():
    """For random merge lists, tokens that end ``lookahead`` bytes before a cut are those of the whole text."""
    rng = random.Random(3)
    for _ in range(300):
        merges, ids = proper_list(rng, b"abc", rng.randint(1, 25))
        v = bpe.Vocabulary(merges, ids)
        for _ in range(20):
            text = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 160)))
            whole = bpe.merge(v, text)
            cut = rng.randint(0, len(text))
            ends, done = [], 0
            for i in whole:
                done += len(v.bytes_of[i])
                ends.append(done)
            done = 0
            for k, i in enumerate(bpe.merge(v, text[:cut])):
                done += len(v.bytes_of[i])
                if done > cut - v.lookahead:
                    break
                assert whole[k] == i and ends[k] == done
            stream = bpe.MergeStream(v)
            stream.window = v.lookahead + 1
            assert [x for c in range(0, len(text), 3) for x in stream.feed(text[c : c + 3])] + stream.finish() == whole
            assert len(stream.held) <= 2 * stream.window + 16


def test_both_merge_loops_agree():
    rng = random.Random(4)
    for _ in range(100):
        merges, ids = proper_list(rng, b"ab", 12)
        v = bpe.Vocabulary(merges, ids)
        for n in (47, 48, 200):
            text = bytes(rng.choice(b"ab") for _ in range(n))
            parts = [v.ids[bytes([c])] for c in text]
            while True:
                pairs = [(v.rank[p][0], k) for k, p in enumerate(zip(parts, parts[1:])) if p in v.rank]
                if not pairs:
                    break
                _, k = min(pairs)
                parts[k : k + 2] = [v.rank[parts[k], parts[k + 1]][1]]
            assert bpe.merge(v, text) == parts


def test_improper_lists_are_refused():
    with pytest.raises(ValueError, match="improper"):
        bpe.lookahead([(b"ab", b"c"), (b"a", b"b")])


def test_decoder_holds_back_unfinished_characters(vocabulary):
    decoder = bpe.Decoder(vocabulary)
    ids = [vocabulary.first[b] for b in "é👍".encode()]
    assert [decoder.feed(bpe.pack([i])) for i in ids] == ["", "é", "", "", "", "👍"]
    assert decoder.feed(bpe.pack(ids[:1])) == "" and decoder.finish() == "�"
    assert decoder.decode(bpe.pack([10**6])) == ""


def test_memory_is_constant(vocabulary):
    encoder = bpe.Encoder(vocabulary)
    held = 0
    for _ in range(40):
        encoder.feed("a" * 5000)
        held = max(held, len(encoder.core.held) + len(encoder.text) + len(encoder.tail))
    assert held <= 2 * encoder.core.window


def test_query(spark, sf, library):
    got = {r["doc_id"]: r for r in queries.op3_bpe(spark, sf).collect()}
    for r in table(spark, sf, "documents").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        own = got[r["doc_id"]]
        assert own["n_tokens"] == len(ids)
        assert own["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark, odd, none):
    out = bpe.round_trip(odd, PATH)
    assert sorted((str(r["id"]), r["text"]) for r in out.collect()) == sorted((str(r["doc_id"]), r["text"] or "") for r in odd.collect())
    apart = bpe.decode(bpe.encode(odd, PATH), PATH)
    assert sorted(map(str, apart.collect())) == sorted(map(str, out.select("id", "text").collect()))
    assert bpe.round_trip(none, PATH).count() == 0
