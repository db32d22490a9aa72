import pytest

import corpus_pipeline
from graphloom.llm.common import materialise, table


@pytest.fixture(scope="module")
def outputs(spark, sf):
    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf), "test")
        out.append((name, docs))
    return out


def test_stages(spark, sf, outputs):
    docs = table(spark, sf, "documents")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, df in outputs[:-1]:
        assert df.dtypes == docs.dtypes, name
        after = {r["doc_id"]: r["text"] for r in df.collect()}
        assert set(after) <= set(before)
        if name != "repeated passages":
            assert all(before[i] == t for i, t in after.items())
        else:
            assert set(after) == set(before) and any(before[i] != t for i, t in after.items())
        before = after
    assert {r["doc_id"] for r in outputs[-1][1].collect()} == set(before)


def test_run_is_the_stages(spark, sf, outputs):
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, outputs[-1][1].collect()))


def test_odd_rows(spark, sf, odd, none):
    own = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd.select(own), none.select(own)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = materialise(stage(spark, docs, sf), "test")
            if k < 4:
                assert docs.columns == own
