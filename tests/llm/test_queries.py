"""Registered queries against SQL, and the pipeline against its parts done by brute force."""

import __spark_entry__ as entry_point
import corpus_pipeline
import numpy as np
import oracle_check
import pytest
from ionframe.llm import common, packing, queries, toxicity, wordbpe

from llm.test_texts import WORD_FILE, near_components, without_windows

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = [n for n in entry_point.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry_point.queries()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, name):
    assert oracle_check.compare(spark, oracle_check.connect(SMALL), queries.QUERIES[name], queries.ORACLE[name], SMALL) is None


def test_pipeline_equals_its_parts(spark):
    docs = common.table(spark, SMALL, "documents")
    model = toxicity.train(docs, common.table(spark, SMALL, "labels"), held_out=None)

    def margin(text):
        return model.margin(set(toxicity.document_features(text).tolist()) & model.weights.keys())

    rows = [(r.doc_id, r.text) for r in docs.collect() if margin(r.text) < 0]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES[:3]:
        frames.append(common.staged(stage(spark, frames[-1], SMALL)))
        assert frames[-1].columns == docs.columns
    assert sorted(r.doc_id for r in frames[1].collect()) == sorted(k for k, _ in rows)
    kept = {k for k, _, _, stays in near_components(rows) if stays}
    rows = [(k, t) for k, t in rows if k in kept]
    assert sorted(r.doc_id for r in frames[2].collect()) == sorted(kept)
    left = {k: n - gone for k, n, gone, _ in without_windows(rows)}
    cut = frames[3].collect()
    assert {r.doc_id: len(common.words(r.text)) for r in cut} == left and all(r.n_chars == len(r.text) for r in cut)
    encoder = wordbpe.library_encoder(WORD_FILE)
    want = sum(len(list(packing.cuts(len(encoder.encode(r.text)) // 4 + 1))) for r in cut)
    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert len(packed) == want and sum(r.length for r in packed) == sum(len(encoder.encode(r.text)) // 4 + 1 for r in cut)
    assert all(np.frombuffer(r.ids, "<u4")[-1] == 2 for r in packed if r.start + r.length == r.doc_tokens)
