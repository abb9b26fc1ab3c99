"""Operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import random
import re
import tracemalloc
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskline.llm import (
    byte_bpe, decontam, gru, jaccard_join, langid, licenses, lm_scoring, sharding, url_filters, vector_near_dups, warc,
)
from deskline.llm.common import prepare
from deskline.llm.components import components

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def _prepared(spark):
    prepare(spark)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_components_equal_union_find(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(170)] + [(1000, 1000 + i) for i in range(60)]
    pairs += [(2000 + i, 2001 + i) for i in range(40)] + [(5, 5), (None, 3), (7, None)]  # a path, a star, loops, nulls
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = components(spark.createDataFrame(pairs, "x long, y long"), "x", "y").collect()
    assert {r["node"]: r["component"] for r in got} == {a: find(a) for a in root} and len(got) == len(root)
    assert components(spark.createDataFrame([], "x string, y string"), "x", "y").count() == 0


def test_url_rules_aliases_and_allow_precedence(spark):
    rules = [url_filters.Rule("allow", "org", "/"), url_filters.Rule("block", "bad.com", "/")]
    pages = spark.createDataFrame([
        (1, "http://a.net/x", "<link rel='canonical' href='http://q.org/1'>"),
        (2, "https://A.net/x/?q=1", "<link href=http://bad.com/1 rel=canonical>"),
        (3, "http://BAD.com/1#f", ""), (4, None, "x"), (5, "no scheme", "<link rel=canonical href=http://z>"),
        (6, "http://r.net/a", "<link rel=canonical href=/b>"), (7, "http://r.net/b", None),
        (7, "http://r.net/b", "<META http-equiv=refresh content='0; url=http://bad.com/2'>"),
        (8, "http://xbad.com/", "<link rel=stylesheet href=http://bad.com/1>"),
        (9, "http://h.com?x=/org/", ""), (10, "http://sub.BAD.com", "")],
        "page_id int, url string, html string").withColumn("component", F.lit("c")).withColumn("v", F.lit(1))
    out = {(r["page_id"], r["verdict"]): r for r in url_filters.judge(pages, rules, url_filters.html_edges(pages)).collect()}
    assert sorted(out) == [(1, "allow"), (2, "allow"), (3, "block"), (4, "allow"), (5, "allow"), (6, "block"), (7, "block"),
                           (8, "allow"), (9, "allow"), (10, "allow")]
    assert out[3, "block"]["rule"] == "bad.com/" and out[4, "allow"]["host"] == "" and out[9, "allow"]["path"] == ""
    assert url_filters.judge(pages.limit(0), rules, url_filters.html_edges(pages.limit(0))).count() == 0
    assert url_filters.judge(pages, [], None).filter("verdict = 'block'").count() == 0


def test_licence_runs_take_the_longest_rule(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
           "to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
           "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of "
           "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
           "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
           "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
           "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
           "IN THE SOFTWARE.")
    short = "See the license for the specific language governing permissions and limitations under the License."
    docs = spark.createDataFrame([(1, mit), (2, None), (3, ""), (4, "Released under the MIT License. " * 5000), (5, short),
                                  (None, "Released under the MIT License.\n\nx"), (5, "...")], DOCS).withColumn("found", F.lit(0))
    got = {(r["doc_id"], r["n_sentences"]): (r["licences"], r["n_left"]) for r in licenses.scan(docs).collect()}
    assert got == {(1, 3): (["MIT"], 0), (2, 0): ([], 0), (3, 0): ([], 0), (4, 5000): (["MIT"] * 5000, 0), (5, 1): ([], 1),
                   (None, 2): (["MIT"], 0), (5, 0): ([], 0)}
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, known={}, rules=[]).count() == 7


def test_url_targets_are_resolved_as_a_browser_does(spark):
    bases = ["http://r.net/a/b/c.html?q=/z/#f", "http://r.net", "http://r.net/", "https://r.net?x=/1", "http://r.net/a"]
    targets = ["page.html", "../x", "../../../../x/", "?p=1", "./", "..", "x/../y?z=../w", "/go?u=http://blocked.com/x", "/a/../b",
               "//other.com/p", "HTTP://Other.com/p", "x?u=http://blocked.com/", "b#f", "svn+x://h/p"]
    pages = spark.createDataFrame([(b, f'<link rel="canonical" href="{t}">') for b in bases for t in targets], "url string, html string")
    assert rows(url_filters.html_edges(pages)) == rows(spark.createDataFrame(
        [(b, t if "://" in t.split("?")[0] else urljoin(b, t)) for b in bases for t in targets], "src string, dst string"))
    none = spark.createDataFrame([("http://r.net/a", f"<link rel=canonical href='{t}'>") for t in ("", "#x", "mailto:a@b")]
                                 + [("no host", "<link rel=canonical href=x>")], "url string, html string")
    assert [r["dst"] for r in url_filters.html_edges(none).collect()] == [None] * 4
    rules = [url_filters.Rule("block", "r.net", "/bad/"), url_filters.Rule("block", "blocked.com", "/")]
    pages = spark.createDataFrame([(1, "http://r.net/ok/p", "<link rel=canonical href='../bad/x'>"),
                                   (2, "http://r.net/q", "<link rel=canonical href='/go?u=http://blocked.com/x'>")],
                                  "page_id int, url string, html string")
    out = url_filters.judge(pages, rules, url_filters.html_edges(pages)).collect()
    assert {r["page_id"]: r["verdict"] for r in out} == {1: "block", 2: "allow"}


MIT = """MIT License

Copyright (c) 2020 A

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
APACHE = """# Copyright 2020 A
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at

     http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""


def test_licences_in_published_layouts(spark):
    bsd = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the "
           "following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this\n"
           "   list of conditions and the following disclaimer.\n")
    binary = ("2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
              "following disclaimer in the documentation and/or other materials provided with the distribution.")
    docs = [(1, MIT, ["MIT"]), (2, APACHE, ["Apache-2.0"]), (3, MIT[MIT.index("THE SOFTWARE IS"):], ["MIT"]),
            (4, "a title without a stop\nReleased under the MIT License.\nmore", ["MIT"]),
            (5, "x\r\n * Licensed under\r\n * CC BY 4.0\r\n * y", ["CC-BY-4.0"]), (6, bsd + binary, ["BSD-2-Clause"]),
            (7, "x is not released under the MIT License.", []), (8, "released under the MIT License for all.", [])]
    got = licenses.scan(spark.createDataFrame([d[:2] for d in docs], DOCS)).collect()
    assert {r["doc_id"]: (r["licences"], r["n_left"]) for r in got} == {i: (names, 0) for i, _, names in docs}


def test_licence_phrases_equal_a_search_of_the_documents(spark, sf_dir):
    phrases = ["released under the mit license", "licensed under the apache license version 2 0", "licensed under cc by nc 4 0",
               "this work is licensed under the gnu general public license version 3", "all rights reserved"]
    between = "|".join(r"[^a-z0-9]+".join(p.split()) for p in phrases)
    search = re.compile(rf"(?:^|\n|[.;!?](?=\s))[^a-z0-9\n]*(?:{between})(?:$|\n|[.;!?](?=\s|$)|[^a-z0-9\n]+(?:$|\n))", re.I)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    lead = spark.createDataFrame([(-1, "a line\nAll rights reserved.")], DOCS)
    docs = docs.union(lead)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"] for r in licenses.scan(docs).filter("size(found) > 0").collect()}
    assert got == {i for i, t in texts.items() if search.search(t or "")} and -1 in got


def test_gru_gradients(monkeypatch):
    monkeypatch.setattr(gru, "TRAIN_LANES", 1)  # no text is cut
    monkeypatch.setattr(gru, "SCORE_LANES", 2)
    monkeypatch.setattr(gru, "WINDOW", 1000)
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) + rng.standard_normal(v.shape) * 0.3 for k, v in gru.initial(np.ones(gru.SYMBOLS)).items()}
    texts = [np.append(rng.integers(0, gru.SYMBOLS, n), 5) for n in (3, 0, 7, 2, 9, 1)]
    grads = {}

    class Held(gru.Trainer):
        def _update(self, g, tokens):
            for k, v in g.items():
                grads[k] = grads.get(k, 0) + v

    Held(p, 0).learn(texts, 5)
    for k in p:
        places = sorted((tuple(rng.integers(0, s) for s in p[k].shape) for _ in range(200)), key=lambda i: -abs(grads[k][i]))
        for i in places[:3]:
            up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
            up[k][i] += 1e-4
            down[k][i] -= 1e-4
            slope = (gru.score(down, texts, 5).sum() - gru.score(up, texts, 5).sum()) / 2e-4
            assert slope == pytest.approx(float(grads[k][i]), rel=1e-3, abs=1e-5)
    alone = sum(gru.score(p, [t], 5)[0] for t in texts)  # state is carried within, never between texts
    assert gru.score(p, texts, 5).sum() == pytest.approx(alone)


def test_gru_probabilities_sum_to_one():
    p = gru.initial(np.arange(gru.SYMBOLS)[::-1].astype(float))
    logs = [gru.score(p, [np.array([7, 3, s], np.int32)], 0)[0] for s in range(gru.SYMBOLS)]
    first = gru.score(p, [np.array([7, 3], np.int32)], 0)[0]
    assert np.exp(np.array(logs) - first).sum() == pytest.approx(1, rel=1e-4)


def test_gru_lanes_take_memory_by_symbols():
    """One text of a million symbols beside 600 short ones: no rectangle of lanes x longest text."""
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, gru.SYMBOLS, n).astype(np.int16) for n in [1_000_000, *rng.integers(1, 60, 600)]]
    total = sum(map(len, texts))
    tracemalloc.start()
    lanes = gru.Lanes(texts, gru.SCORE_LANES, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * total
    told = [[] for _ in texts]
    for t0 in range(0, lanes.steps, 32):
        x, y, text, first, live = lanes.span(t0, min(t0 + 32, lanes.steps))
        if live[0] == 1:  # the long one alone
            assert (text == 0).all() and not first.any() and (x[1:, 0] == y[:-1, 0]).all()
            told[0].append(y[:, 0])
            continue
        for t, k in enumerate(live):
            for lane in range(k):
                i = text[t, lane]
                assert first[t, lane] == (not told[i]) and x[t, lane] == (told[i][-1][-1] if told[i] else 5)
                told[i].append(y[t, lane:lane + 1])
    assert all((np.concatenate(a) == b).all() for a, b in zip(told, texts))


def test_gru_scores_a_long_text_in_bounded_memory():
    rng = np.random.default_rng(2)
    texts = [rng.integers(0, gru.SYMBOLS, n).astype(np.int16) for n in [60_000, *rng.integers(1, 60, 600)]]
    p = gru.initial(np.ones(gru.SYMBOLS))
    tracemalloc.start()
    got = gru.score(p, texts, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    assert got[[0, 1, 600]] == pytest.approx([gru.score(p, [texts[i]], 5)[0] for i in (0, 1, 600)], rel=1e-4)


def test_lm_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HOT", 5)  # most tokens go by the join
    docs = spark.createDataFrame([(1, "a b a c d e f g h"), (1, "a b a c d e f g h"), (2, None), (3, ""), (None, " \t "),
                                  (4, "zz unseen A"), (6, "a b " * 20_000)], DOCS).withColumn("row", F.lit(1)).withColumn("c", F.lit(2))
    out = lm_scoring.score_documents(docs, F.coalesce(F.col("doc_id") == 4, F.lit(False))).collect()
    assert len(out) == 7
    by = {r["doc_id"]: r for r in out}
    assert by[2]["n_tokens"] == by[3]["n_tokens"] == by[None]["n_tokens"] == 1 and by[6]["n_tokens"] == 40_001
    assert by[4]["held_out"] and by[4]["n_known"] == 2  # "a" and the end
    n, v = 2 * 10 + 3 + 40_001, 9  # training tokens; a to h and the end
    assert by[4]["train_tokens"] == n
    count = {"a": 20_004, "end": 6}
    expect = sum(np.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in (0, 0, count["a"], count["end"]))
    assert by[4]["base_score"] == pytest.approx(expect)
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert lm_scoring.score_documents(docs.limit(0), F.lit(False)).count() == 0
    assert lm_scoring.score_documents(docs, F.lit(True)).filter("n_known = 0 AND train_tokens = 0").count() == 7


def test_lm_is_a_distribution_over_tokens(spark, monkeypatch):
    """Known tokens and one unseen token of each ending share all of the probability."""
    monkeypatch.setattr(lm_scoring, "HOT", 4)
    train = spark.createDataFrame([(i, f"a b c{i} d{i} a") for i in range(30)], DOCS)
    seen = sorted({w for i in range(30) for w in f"a b c{i} d{i} a".split()})
    unseen, n = {}, 0
    while len(unseen) < lm_scoring.ENDINGS:
        unseen.setdefault(lm_scoring._ending(f"u{n}".encode()), f"u{n}")
        n += 1
    probe = spark.createDataFrame([(1000 + i, w) for i, w in enumerate([*seen, *unseen.values(), ""])], DOCS)
    out = lm_scoring.score_documents(train.union(probe), F.col("doc_id") >= 1000).filter("held_out").collect()
    # P(word, end) = P(word) P(end | word) <= P(word); with the empty text's P(end) the sum stays below one
    total = sum(10 ** r["score"] for r in out)
    assert 0 < total <= 1 + 1e-6


@pytest.mark.parametrize("chunk", [7, 64 << 10])
def test_warc_round_trip(spark, tmp_path, chunk):
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 20_000
    pages = spark.createDataFrame([
        (1, "http://a/1", big), (2, "http://a/2\r\nX: y", big), (2, "http://a/2\r\nX: y", big), (3, None, None), (4, "", ""),
        (5, "u", "x" * 999), (6, "u", "x" * 999), (7, "u", "x" * 1000), (8, "u", "x" * 1000), (None, "u", "x" * 1000)],
        "page_id long, url string, html string").withColumn("digest", F.lit("d")).withColumn("id", F.lit(0))
    if chunk == 7:
        pages = pages.filter("page_id IS NULL OR page_id > 2")
    manifest = warc.write_archives(warc.plan_records(pages), f"file://{tmp_path}/w", chunk)
    table = warc.read_archives(manifest, chunk).collect()
    assert manifest.agg(F.sum("records")).first()[0] == pages.count()
    for r in table:
        assert len(r["data"]) <= chunk and r["offset"] == r["chunk_no"] * chunk
    ends = sorted((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in table if r["last"])
    page = "<urn:page:{}>".format
    expect = [(page(3), "response", None, 0), (page(4), "response", None, 0), (page(5), "response", None, 999),
              (page(6), "response", None, 999), (page(7), "revisit", page(8), 1000), (page(8), "response", None, 1000),
              (page("None").replace("None", "null"), "revisit", page(8), 1000)]
    if chunk > 7:
        n = len(big.encode())
        expect += [(page(1), "revisit", page(2), n), (page(2), "response", None, n), (page(2), "response", None, n)]
    assert sorted((a.replace("None", "null"), b, c, d) for a, b, c, d in ends) == sorted(expect, key=str)
    assert all(r["running_digest"] == r["payload_digest"] for r in table if r["last"] and r["record_type"] == "response")
    empty = warc.write_archives(warc.plan_records(pages.limit(0)), f"file://{tmp_path}/e")
    assert warc.read_archives(empty).count() == 0


def test_decontamination_blocks_and_odd_items(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "x one two three four five six seven eight nine TEN eleven y"), (2, "short item"), (3, None),
                                  (4, ""), (5, "solo"), (None, "solo"), (6, "one two three four five six seven eight nine"),
                                  (7, "a " * 30_000 + "Short, item!"), (2, "short item")], DOCS).withColumn("n_words", F.lit(0))
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (10, "short item"), (9, "short item"),
                                   (3, "solo"), (4, None), (5, " .. "), (None, "solo")], "item_id long, text string").withColumn("id", F.lit(1))
    def run(d, i):
        return {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in decontam.decontaminate(d, i).collect()}
    expect = {(1, 13, 11, ("1",)), (2, 2, 2, ("10", "9")), (3, 0, 0, ()), (4, 0, 0, ()), (5, 1, 1, ("3",)), (None, 1, 1, ("3",)),
              (6, 9, 0, ()), (7, 30_002, 2, ("10", "9"))}
    assert run(docs, items) == expect
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 4)  # the benchmark in blocks gives the same
    assert run(docs, items) == expect
    assert {n for _, _, n, _ in run(docs, items.limit(0))} == {0}
    assert decontam.decontaminate(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 2])
def test_decontamination_keeps_every_row(spark, monkeypatch, block):
    """Repeated and null ids of equal length are rows of their own, with one benchmark block or several."""
    monkeypatch.setattr(decontam, "BLOCK_WORDS", block)
    docs = spark.createDataFrame([(1, "red fish"), (1, "blue bird"), (1, "blue bird"), (1, "clean text"), (None, "red fish"),
                                  (None, "clean text"), (None, "clean text"), (2, None), (2, "")], DOCS)
    items = spark.createDataFrame([(1, "red fish"), (2, "blue bird"), (3, "green tree")], "item_id long, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in decontam.decontaminate(docs, items).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 2, ("1",)), (1, 2, 2, ("2",)), (1, 2, 2, ("2",)), (1, 2, 0, ()),
                                           (None, 2, 2, ("1",)), (None, 2, 0, ()), (None, 2, 0, ()), (2, 0, 0, ()), (2, 0, 0, ())], key=str)


def brute_links(rows, threshold):
    ok = {}
    for n, (i, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            x = x / np.abs(x).max()
            ok[n] = (label, x / np.linalg.norm(x))
    links = {n: [m for m in ok if m != n and ok[m][0] == ok[n][0] and len(ok[m][1]) == len(ok[n][1])
                 and ok[m][1] @ ok[n][1] >= threshold] if n in ok else [] for n in range(len(rows))}
    out = []
    for n, (i, _, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for m in links[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        ids = [rows[m][0] for m in seen if rows[m][0] is not None]
        least = min(ids) if ids else None
        out.append((i, len(links[n]), least, i == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [7, 1024])
def test_vector_links_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(vector_near_dups, "TILE", tile)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((6, 24))
    data = []
    for i in range(150):
        v = centres[i % 6] + rng.standard_normal(24) * rng.choice([0.05, 0.12, 0.6])
        data.append((i, [float(np.float32(x)) for x in v], int(i % 3 == 0)))
    data += [(900 + i, data[3][1], data[3][2]) for i in range(20)]  # copies
    data += [(800, None, 1), (801, [], 1), (802, [0.0] * 24, 1), (803, [1.0, None] * 12, 1), (804, [float("nan")] * 24, 1),
             (805, [float("inf")] + [0.0] * 23, 1), (806, data[0][1], None), (807, [1.0, 2.0], 1), (808, [2.0, 4.0], 1),
             (None, data[3][1], data[3][2]), (3, data[3][1], data[3][2]), (809, [1e-30] * 24, 1), (810, [1e30] * 24, 1)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("k"))
    got = sorted((tuple(r) for r in vector_near_dups.link_vectors(vectors).collect()), key=str)
    assert got == brute_links([(i, v, lab) for i, v, lab in data], 0.98)
    assert vector_near_dups.link_vectors(vectors.limit(0)).count() == 0


def test_language_model_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the house and the river", "en"), (2, "das haus und der fluss", "de"), (3, None, "en"),
                                  (4, "", None), (5, "12 !", "de"), (None, "THE HOUSE", None), (7, "der " * 200_000, None)],
                                 DOCS + ", lang string").withColumn("score", F.lit(1))
    model = langid.train(docs)
    out = docs.select("doc_id", langid.predict_column(F.col("text"), spark, model).alias("p")).select("doc_id", "p.*")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[1][0] == "en" and got[2][0] == got[7][0] == "de" and got[None][0] == "en"
    none = langid.train(docs.limit(0))
    assert none.langs == [] and none.score(["the house"])[0] == ["und"]


def test_ngrams_do_not_depend_on_the_batch():
    rnd = random.Random(2)
    for _ in range(200):
        texts = ["".join(rnd.choice("aé 1!ßİ漢") for _ in range(rnd.randint(0, 8))) for _ in range(rnd.randint(1, 6))]
        ids, docs, letter = langid.ngram_buckets(texts)
        for i, t in enumerate(texts):
            one, _, has = langid.ngram_buckets([t])
            assert sorted(ids[docs == i]) == sorted(one) and has[0] == letter[i] == any(map(str.isalpha, t))


def test_jaccard_of_texts_that_repeat_a_thousand_times(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_TOKENS", 50)  # several buckets
    base = [f"w{i}" for i in range(60)]
    near = base[:-1] + ["other"]
    far = base[:30] + [f"x{i}" for i in range(30)]
    texts = [(7, " ".join(base))] * 1000 + [(3, " ".join(near))] * 1000 + [(9, " ".join(far)), (None, " ".join(far))] + [(4, " ".join(base))]
    out = jaccard_join.link_table(spark.createDataFrame(texts, DOCS).repartition(5), width=3, percent=80)
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["n"]) for r in out.groupBy("doc_id", "n_shingles", "component_id").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert got == {(7, 58, 3, 1000), (3, 58, 3, 1000), (4, 58, 3, 1), (9, 58, 9, 1), (None, 58, 9, 1)}


@pytest.mark.parametrize("large,tile", [(64, 1 << 18), (2, 40)])
def test_jaccard_equals_all_pairs(spark, monkeypatch, large, tile):
    from tests.llm.test_queries import jaccard_components
    monkeypatch.setattr(jaccard_join, "LARGE", large)  # all groups in tiles, too
    monkeypatch.setattr(jaccard_join, "STAR", 2 if large == 2 else 8)
    monkeypatch.setattr(jaccard_join, "TILE_TOKENS", tile)
    rnd = random.Random(5)
    texts = {}
    for i in range(12):
        base = [rnd.choice("abcdefghijklmnop") * rnd.randint(1, 3) for _ in range(rnd.choice([6, 30, 60]))]
        for j in range(12):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                w[rnd.randrange(len(w))] = f"n{rnd.randint(0, 99)}"
            texts[i * 100 + j] = rnd.choice([" ", "  \n"]).join(w)
    texts |= {5000: None, 5001: "", 5002: " \t", 5003: "one two", 5004: "One  two", 5005: "one", 5006: "x " * 40_000, 5007: "x " * 40_001}
    docs = spark.createDataFrame(list(texts.items()), DOCS).withColumn("node", F.lit(1)).withColumn("n_shingles", F.lit(1))
    out = jaccard_join.link_table(docs, width=3, percent=70)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == jaccard_components(texts, 3, 70)
    again = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (0, "a b c d e")], DOCS)
    assert rows(jaccard_join.link_table(again, width=2, percent=70)) == [(0, 4, 0), (1, 3, 0), (1, 3, 0), (None, 0, None), (None, 3, 0)]
    assert jaccard_join.link_table(docs.limit(0)).count() == 0


@pytest.mark.parametrize("cell", [3, 20_000])
def test_shards_match_the_mixture(spark, monkeypatch, cell):
    monkeypatch.setattr(sharding, "CELL_ROWS", cell)
    data = [(i, "hot" if i % 3 else f"s{i % 7}") for i in range(200)] + [(None, None), (None, None), (5, "s1"), (5, "s1")]
    df = spark.createDataFrame(data, "doc_id long, source string").withColumn("shard", F.lit(1)).withColumn("_rank", F.lit(1))
    out = sharding.assign_shards(df, "doc_id", "source", 8, carry=["source"]).collect()
    assert len(out) == len(data)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    assert sorted(by) == list(range(8))
    sizes = [len(v) for v in by.values()]
    assert max(sizes) - min(sizes) <= 1
    for v in by.values():
        assert sorted(r["slot"] for r in v) == list(range(len(v)))
    for source in {s for _, s in data}:
        n = sum(s == source for _, s in data)
        for v in by.values():
            assert abs(sum(r["source"] == source for r in v) - n / 8) <= 2
    assert sharding.assign_shards(df.limit(0), "doc_id", "source", 8).count() == 0


def test_bpe_equals_tiktoken_on_odd_texts(spark):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.load_ranks(path), special_tokens={})
    rnd = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "…", "漢", "😀", "\x1c",
             "\x00", "'s", "'S", "　", " ", "abc", "̈"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "\n\n", "a" * 5000, "' " * 999, "x" * 70, "word " * 50_000, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit(1))
    encoded = byte_bpe.encode_documents(docs.union(docs.filter("doc_id = 5")), path)
    got = byte_bpe.decode_documents(encoded.select("doc_id", "ids"), path).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["ids"] == enc.encode_ordinary(text) and bytes(r["decoded"]) == text.encode()
    tokens = byte_bpe._token_bytes(path)
    for r in encoded.filter("doc_id < 200").collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert [raw[a:a + len(tokens[i])] for a, i in zip(r["starts"], r["ids"])] == [tokens[i] for i in r["ids"]]
    assert byte_bpe.encode_documents(docs.limit(0), path).count() == 0


def test_chunks_of_a_large_payload(spark):
    big = "".join(chr(97 + i % 26) for i in range(1 << 16)) * 64  # 4 MB
    rows = spark.createDataFrame([(1, "u", big), (2, "u", "é" * 700), (3, "v", None), (4, "v", big)], "page_id bigint, url string, html string")
    records = warc.plan_records(rows)
    chunks = warc.chunk_rows(records, 1000)
    got: dict[str, list] = {}
    for r in chunks.collect():
        got.setdefault(r["id"], []).append((r["chunk_no"], bytes(r["data"])))
    want = {"1": b"", "2": ("é" * 700).encode(), "3": b"", "4": big.encode()}  # the older copy revisits the newest
    for name, text in want.items():
        parts = sorted(got[name])
        assert [n for n, _ in parts] == list(range(max(1, -(-len(text) // 1000))))
        assert b"".join(d for _, d in parts) == text and all(len(d) <= 1000 for _, d in parts)
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(sequence(0" in plan and "transform(" not in plan


def test_linked_sets_share_as_many_prefix_tokens_as_the_filter_asks():
    rng = np.random.default_rng(5)
    for percent in (70, 80, 85):
        for n in (1, 2, 7, 40, 900):
            base = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
            orders = jaccard_join.Orders(rng.permutation(base)[:n // 3], percent)  # some tokens are frequent
            for cut in {0, n // 20, n // 8, n // 5}:
                a, b = np.unique(base[:n]), np.unique(base[cut:n + cut // 2])
                both = len(np.intersect1d(a, b))
                if 100 * both < percent * (len(a) + len(b) - both):
                    continue  # not linked
                need = -(-percent * (len(a) + len(b)) // (100 + percent))
                assert both >= need
                for p, q in zip(orders.prefixes(a), orders.prefixes(b)):
                    least = need + 1 - -(-percent * max(len(a), len(b)) // 100)
                    assert least >= 1 and len(np.intersect1d(p, q)) >= least
                    p16, q16 = np.unique(p.astype(np.uint16)), np.unique(q.astype(np.uint16))
                    hidden = min(len(p) - len(p16), len(q) - len(q16))
                    assert len(np.intersect1d(p16, q16)) >= least - hidden


@pytest.mark.parametrize("doc_id, source", [("id", "concat('s', id)"), ("CAST(NULL AS BIGINT)", "'one'"), ("7L", "'s'")])
def test_shards_of_one_row_sources_and_of_one_id(spark, monkeypatch, doc_id, source):
    data = spark.range(600).selectExpr(f"{doc_id} AS doc_id", f"{source} AS source", "id AS n")
    got = []
    for cell in (50, 100_000):
        monkeypatch.setattr(sharding, "CELL_ROWS", cell)
        out = sharding.assign_shards(data, "doc_id", "source", 8, carry=["n"])
        got.append(sorted((r["n"], r["shard"], r["slot"]) for r in out.collect()))
    assert got[0] == got[1] and len({(s, p) for _, s, p in got[0]}) == len(got[0]) == 600
