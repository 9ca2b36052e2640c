"""The pipeline on the smallest tables, stage by stage against brute force."""

import corpus_pipeline
from counterpoise.llm import common

from test_corpus_operators import base_spans, best_windows, linked


def test_stages(spark, small):
    docs = common.table(spark, small, "documents")
    columns = docs.columns
    bench = [(r["item_id"], r["text"]) for r in common.table(spark, small, "benchmark").collect()]
    sizes = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = common.cut(stage(spark, docs, small), "stage")
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        sizes[name] = len(after)
        if name == "near_duplicates":
            assert set(after) == {i for i, (_, c) in linked(before.items()).items() if i == c}
        if name == "decontamination":
            assert set(after) == set(before) - {i for i, _ in best_windows(before.items(), bench)}
        if name == "pii":
            assert set(after) == set(before)
            assert all(not base_spans(t or "") for t in after.values())
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, small)
    assert {r["doc_id"] for r in out.collect()} == set(after)
    assert corpus_pipeline.run(spark, small).count() == out.count()


def test_empty_and_null_rows(spark, docs, small):
    at = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (at, at.limit(0)):
        df = start
        for _, stage in corpus_pipeline.STAGES:
            df = common.cut(stage(spark, df, small), "stage")
        assert df.count() >= 0
