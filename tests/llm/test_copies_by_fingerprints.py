"""The pipeline's stage takes its candidates by fingerprints too, and judges them by their whole sets."""

import numpy as np
import pytest

import corpus_pipeline
from blockloom.llm import simhash


@pytest.mark.parametrize("far", [False, True])
def test_candidates_come_from_fingerprints(spark, monkeypatch, far):
    monkeypatch.setattr(simhash, "copy_keys", lambda h: h.sum(keepdims=True, dtype=np.uint64))  # none that two sets share
    words = [f"w{k}" for k in range(600)]
    near = [*words[:599], "other"]
    apart = [f"v{k}" for k in range(600)]
    rows = [(1, " ".join(words)), (2, " ".join(apart if far else near)), (3, ""), (4, None), (5, "a few other words for this row")]
    if not far:
        assert bin(simhash.fingerprint(rows[0][1]) ^ simhash.fingerprint(rows[1][1])).count("1") <= simhash.RADIUS
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted(r.doc_id for r in corpus_pipeline.one_of_copies(spark, docs, "").collect())
    assert kept == ([1, 2, 3, 5] if far else [1, 3, 5])
