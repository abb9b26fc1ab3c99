"""The pipeline's stages against plain models of their rules, and odd inputs."""

import re

import corpus_pipeline as P
from deskline.llm.common import table
from tests.llm.test_queries import jaccard_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def hits(text, windows):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return any(tuple(w[i:i + n]) in windows for n in {len(x) for x in windows} for i in range(len(w) - n + 1))


def bench_windows(items):
    out = set()
    for text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        out |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    return out


def test_run_equals_the_rules(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    kept = P.language_id(spark, table(spark, sf_dir, "documents"), sf_dir)
    assert kept.columns == table(spark, sf_dir, "documents").columns
    kept = {r["doc_id"] for r in kept.collect()}
    assert len(kept) >= 0.99 * len(docs)  # prose in a learned language stays
    one = {i for i, (_, c) in jaccard_components({i: docs[i] for i in kept}, 5, 80).items() if c == i}
    windows = bench_windows(r["text"] for r in table(spark, sf_dir, "benchmark").collect())
    clean = {i for i in one if not hits(docs[i], windows)}
    rows = P.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == clean and len(rows) == len(clean)
    assert all(r["n_tokens"] == len(r["ids"]) for r in rows)
    assert len(clean) < len(one) < len(kept)


def odd(spark):
    long = "the other house " * 30_000
    rows = [(1, "the house of the river and the house", "en", "a", 1), (2, None, "en", None, None), (3, "", None, "a", 0),
            (4, "123 !!", "en", "a", 1), (None, "the house of the river", "en", "a", 1), (None, "the house of the river", "en", "a", 1),
            (5, "the house of the river and the house", "en", "a", 1), (5, "the house of the river and the house", "en", "a", 1),
            (6, long, "en", "a", 1), (7, long, "en", "a", 1), (8, "der fluss und das haus", "de", "a", 1)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS score", "1 AS _dropped", "2 AS component_id", "3 AS node")


def test_odd_rows_and_clashing_columns(spark, sf_dir):
    docs = odd(spark)
    told = P.language_id(spark, docs, sf_dir)
    assert told.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in told.collect()) == ["1", "5", "5", "6", "7", "8", "None", "None"]
    one = P.near_duplicates(spark, docs, sf_dir)
    assert one.columns == docs.columns
    # one row of a repeated id, the smallest id of a group, null ids and wordless texts as they are
    assert sorted(str(r["doc_id"]) for r in one.collect()) == ["1", "2", "3", "4", "6", "8", "None", "None"]
    clean = P.decontaminate(spark, docs, sf_dir)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert P.encode(spark, docs, sf_dir).count() == docs.count()


def test_empty_table(spark, sf_dir):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
        assert name == "byte_bpe" or out.columns == docs.columns


def test_a_text_of_its_own_is_not_lost_with_a_repeated_id(spark, sf_dir):
    a, b = "the house of the river and the house by it", "der fluss und das haus am anderen ende der stadt"
    docs = spark.createDataFrame([(2, a, "en", "x", 1), (5, a, "en", "x", 1), (5, b, "de", "x", 1), (-30, b, "de", "x", 1)], SCHEMA)
    kept = sorted((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs.filter("doc_id > 0"), sf_dir).collect())
    assert kept == [(2, a), (5, b)]
    kept = sorted((r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, sf_dir).collect())
    assert kept == [(-30, b), (2, a)]  # the smallest id of a group, negative ones first
