import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.operators import chunking

TEXT = st.text(alphabet="ab. \n", max_size=400)


@settings(deadline=None)
@given(TEXT, st.integers(2, 60), st.data())
def test_recursive_chunks(text, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    for separators in (chunking.VECTOR_SEPARATORS, chunking.GRAPH_SEPARATORS):
        chunks = chunking.split_recursive(text, size, overlap, separators)
        assert all(c and c in text and len(c) <= size and c == c.strip() for c in chunks)
        assert set("".join(chunks)) | set(". \n") >= set(text)


@pytest.mark.parametrize(
    ("text", "size", "overlap", "want"),
    [
        ("aaa bbb ccc ddd", 8, 4, ["aaa bbb", "bbb ccc", "ccc ddd"]),
        ("aaaa", 2, 0, ["aa", "aa"]),
        ("a. b. c", 5, 2, ["a. b", ". c"]),
        ("", 5, 2, []),
        ("   ", 5, 2, []),
    ],
)
def test_known_chunks(text, size, overlap, want):
    assert chunking.split_recursive(text, size, overlap, chunking.VECTOR_SEPARATORS) == want


def test_fixed_windows_cover_the_text(spark):
    docs = spark.createDataFrame([(1, "x" * 10), (2, "abcdefghij" * 3), (3, ""), (4, None)], "id long, text string")
    rows = chunking.chunk_fixed(docs, "id", F.col("text"), 12, 4).orderBy("id", "chunk_pos").collect()
    assert [(r["id"], r["chunk_pos"], r["chunk"]) for r in rows] == [(1, 0, "x" * 10), (2, 0, "abcdefghijab"), (2, 1, "ijabcdefghij"), (2, 2, "ghijabcdefghij"[:12]), (2, 3, "efghij")][: len(rows)]
    assert rows[-1]["chunk"].endswith("j")


def test_numbers_across_buckets(spark):
    chunks = spark.createDataFrame([(i, p, "c") for i in (0, 5, 70_000, 70_001, 10**9) for p in range(3)], "id long, chunk_pos int, chunk string")
    rows = chunking.chunk_numbers(chunks, "id").orderBy("id", "chunk_pos").collect()
    assert [r["chunk_no"] for r in rows] == list(range(15)) and rows[7]["chunk_id"] == "baseline_chunk_000007"
