"""Registered queries of the package: DuckDB SQL where there is some, else a model of the contract."""

import hashlib
import math
import zlib
from collections import Counter

import pytest

import __spark_entry__ as E
from deskline.llm.queries import ORACLES, QUERIES
from tests.oracle_harness import compare, duck


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_dir, name):
    res = compare(spark, name, sf_dir, duck(sf_dir))
    assert res["status"] == "match", res


def test_entry_registers_all_operators_and_the_pipeline():
    names = E.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert set(QUERIES) <= set(names)


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    return {r["doc_id"]: r["text"] for r in rows}


def words(text):
    return (text or "").encode().lower().split()


def test_op3_base_scores_and_a_better_model(spark, sf_dir, texts):
    c = Counter()
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    for i, t in texts.items():
        if not held[i]:
            c.update([*words(t), "<end>"])
    n, v = sum(c.values()), len(c)
    rows = QUERIES["op3_gated_lm"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        w = [*words(texts[r["doc_id"]]), "<end>"]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held[r["doc_id"]], len(w), n)
        assert r["n_known"] == sum(c[x] > 0 for x in w)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0
    learned = [r for r in rows if not r["held_out"]]
    assert sum(r["score"] for r in learned) > sum(r["base_score"] for r in learned)


def test_op7_held_out_accuracy(spark, sf_dir):
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op7_language_id"](spark, sf_dir).collect()
    assert len(rows) == len(langs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == langs[r["doc_id"]] for r in held) >= 0.97 * len(held)


def jaccard_components(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = [i for i in sorted(sets) if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_op8_equals_all_pairs(spark, sf_dir, texts):
    rows = QUERIES["op8_ngram_jaccard"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == jaccard_components(texts, 4, 85)


def test_op10_equals_tiktoken(spark, sf_dir, texts):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    from deskline.llm.byte_bpe import load_ranks
    enc = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=load_ranks(public.path("byte_bpe_50k.tiktoken")),
                            special_tokens={})
    rows = QUERIES["op10_byte_bpe"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
