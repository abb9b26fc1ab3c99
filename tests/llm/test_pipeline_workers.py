"""Pipeline: a task of the last stage runs one Python worker, not one that encodes and another that decodes."""

import hashlib

import corpus_pipeline


def test_encoding_and_decoding_are_not_in_one_task(spark):
    texts = [(1, "a bé c"), (2, ""), (3, None), (3, "again"), (None, "no id")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    out = corpus_pipeline.encode(spark, docs, "")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = sorted((str(r["doc_id"]), r["decoded_sha256"], len(r["ids"])) for r in out.collect())
    assert [(i, d) for i, d, _ in got] == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts)
    assert [n > 0 for *_, n in got] == [bool(dict((hashlib.sha256((t or "").encode()).hexdigest(), t) for _, t in texts)[d]) for _, d, _ in got]
