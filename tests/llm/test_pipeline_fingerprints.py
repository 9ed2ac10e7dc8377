"""The pipeline's near-duplicate stage gets its rows through the fingerprints of operator 5."""

import corpus_pipeline as pipeline
from noticeengine.llm import simhash


def test_linked_fingerprints_go(spark, monkeypatch):
    body = " ".join(f"word{i}" for i in range(400))
    texts = [body, body.upper(), " ".join(f"other{i}" for i in range(400)), body.replace(" ", "  ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    linked = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda df: seen.append(1) or linked(df))
    assert sorted(r.doc_id for r in pipeline.drop_near_copies(spark, docs, "").collect()) == [0, 2] and seen
