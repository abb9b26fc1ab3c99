"""Merkle manifest, prefix trie and toxicity on small tables, against plain Python models."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskline.llm import merkle, prefix_trie, toxicity
from deskline.llm.common import prepare
from deskline.llm.decontam import words
from deskline.llm.queries import QUERIES


@pytest.fixture(scope="module", autouse=True)
def _prepared(spark):
    prepare(spark)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- operator 11 ----------------------------------------------------------------------------------
def tree(digests, fanout):
    """Root and every leaf's path, level by level."""
    paths = [[] for _ in digests]
    at = list(range(len(digests)))
    while len(digests) > 1:
        for i, p in enumerate(at):
            run = p // fanout * fanout
            paths[i].append(("".join(digests[run:p]), "".join(digests[p + 1:run + fanout])))
        digests = [sha("".join(digests[i:i + fanout])) for i in range(0, len(digests), fanout)]
        at = [p // fanout for p in at]
    return digests[0], paths


def manifest_model(rows, fanout):
    """rows: (id, group, leaf); the set of (id, leaf, subroot, root, path)."""
    groups = defaultdict(list)
    for i, g, leaf in rows:
        groups[g].append((i, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    low = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        low[g] = tree([leaf for _, leaf in groups[g]], fanout)
    root, high = tree([low[g][0] for g in names], fanout)
    out = []
    for k, g in enumerate(names):
        for (i, leaf), path in zip(groups[g], low[g][1]):
            out.append((i, leaf, low[g][0], root, tuple(path + high[k])))
    return sorted(out, key=str)


@pytest.mark.parametrize("fanout,size", [(8, 1), (8, 9), (2, 21), (8, 700)])
def test_manifest_equals_a_plain_tree(spark, fanout, size):
    rnd = random.Random(size)
    rows = [(None if i % 40 == 3 else i * 7 % 1000 - 300, None if i % 5 == 1 else rnd.choice(["de", "en", "en", "en", "É", "x"]), f"text {i % 90}")
            for i in range(size)] + [(5, "en", "same"), (5, "en", "same"), (5, "en", None), (6, "lone", "")][:size]
    df = spark.createDataFrame(rows, "id long, lang string, leaf string").withColumn("path", F.lit(1)).withColumn("g", F.lit("x"))
    got = merkle.manifest(df, "id", "lang", merkle.leaf_digest([F.col("id"), F.col("leaf")]), fanout=fanout).collect()

    def enc(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    want = manifest_model([(i, g, sha(enc(i) + enc(t))) for i, g, t in rows], fanout)
    assert sorted([(r["id"], r["leaf"], r["subroot"], r["root"], tuple((x["left"], x["right"]) for x in r["path"])) for r in got], key=str) == want
    assert all(r["verified"] and r["folded_root"] == r["root"] for r in got)


def test_manifest_finds_a_changed_leaf(spark):
    df = spark.createDataFrame([(i, "a", f"T{i}") for i in range(30)] + [(99, "b", "t")], "id long, lang string, text string")
    leaf = merkle.leaf_digest([F.col("id"), F.col("text")])
    other = F.when(F.col("id") % 4 == 3, merkle.leaf_digest([F.col("id"), F.lower("text")]))
    got = {r["id"]: r["verified"] for r in merkle.manifest(df, "id", "lang", leaf, other).collect()}
    assert got == {**{i: i % 4 != 3 for i in range(30)}, 99: True}  # 99 has no capitals


def test_manifest_of_nothing(spark):
    none = spark.createDataFrame([], "id long, lang string, text string")
    assert merkle.manifest(none, "id", "lang", merkle.leaf_digest([F.col("text")])).collect() == []
    with pytest.raises(ValueError):
        merkle.manifest(none, "id", "lang", F.col("text"), fanout=1)


# --- operator 12 ----------------------------------------------------------------------------------
def trie_model(convs):
    """convs: id -> list of (fingerprint, size)."""
    members, kids, size, ends = defaultdict(list), defaultdict(set), {(): 0}, defaultdict(list)
    for c in sorted(convs):
        key = tuple(f for f, _ in convs[c])
        ends[key].append(c)
        for d in range(len(key) + 1):
            members[key[:d]].append(c)
            if d:
                kids[key[:d - 1]].add(key[:d])
                size[key[:d]] = convs[c][d - 1][1]
    leaves, saved = Counter(), Counter()
    for key in members:
        for d in range(len(key) + 1):
            leaves[key[:d]] += not kids[key]
            saved[key[:d]] += (len(members[key]) - 1) * size[key]
    return sorted([(members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(kids[k]), leaves[k],
                    saved[k], sha(",".join(map(str, ends[k])))) for k in members], key=str)


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(spark, convs, shard=None, block=None, monkeypatch=None):
    if shard:
        monkeypatch.setattr(prefix_trie, "SHARD", shard)
        monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = [(c, p, f, s) for c, turns in convs.items() for p, (f, s) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv long, pos long, fp string, size long")
    return prefix_trie.prefix_trie(turns, spark.createDataFrame([(c,) for c in convs], "conv long"))


def test_trie_equals_a_plain_one(spark):
    rnd = random.Random(5)
    convs = {c: [(f"t{rnd.randint(0, 2)}", 3) for _ in range(rnd.randint(0, 5))] for c in random.Random(2).sample(range(-500, 9000), 2500)}
    convs[7777777] = []
    got = trie(spark, convs)
    assert sorted([tuple(r[c] for c in COLS) for r in got.collect()], key=str) == trie_model(convs)


def test_trie_of_long_conversations_runs_over_blocks(spark):
    long = [(f"l{i}", i % 7) for i in range(2 * prefix_trie.BLOCK + 40)]
    convs = {1: long, 2: long[:prefix_trie.BLOCK], 3: long[:prefix_trie.BLOCK + 3], 4: long[:300] + [("other", 5)],
             5: long, 6: long[:prefix_trie.BLOCK - 1] + [("x", 1)], 8: [], 9: [("y", 2)]}
    got = trie(spark, convs)
    assert sorted([tuple(r[c] for c in COLS) for r in got.collect()], key=str) == trie_model(convs)


def test_trie_of_nothing(spark):
    assert trie(spark, {}).collect() == []
    [only] = trie(spark, {3: []}).collect()
    assert (only["conv_id"], only["depth"], only["n_leaves"], only["ends_sha256"]) == (3, 0, 1, sha("3"))


def test_turns_are_placed_and_grafted(spark):
    turns = spark.createDataFrame(
        [(100, 2, "user", "c", 0), (100, None, "user", "a", 0), (100, 1, None, "b", 0), (100, 1, None, "b", 0), (101, 0, "user", None, 0),
         (101, 1, "user", "", 0), (102, 0, "", "z", 0), (250, 0, "user", "q", 0), (None, 0, "user", "lost", 0)],
        "conv_id long, turn long, role string, text string, pos int")
    placed = prefix_trie.placed_turns(turns)
    got = {(r["conv"], r["pos"]): r["size"] for r in placed.collect()}
    assert got == {(100, 0): 1, (100, 1): 1, (100, 2): 1, (100, 3): 1, (101, 0): 0, (101, 1): 0, (102, 0): 1, (250, 0): 1}
    fps = {(r["conv"], r["pos"]): r["fp"] for r in placed.collect()}
    assert fps[101, 0] == fps[101, 1]  # a null text is an empty one
    rebuilt, members = prefix_trie.graft_heads(placed, F.expr("conv - conv % 100"), F.expr("conv % 3"), 2)
    rows = defaultdict(list)
    for r in sorted(rebuilt.collect(), key=lambda r: (r["conv"], r["pos"])):
        rows[r["conv"]].append(r["fp"])
    # keep: 100 -> 1, 101 -> 2, 102 -> 0, 250 -> 1 (there is no 200)
    assert rows == {100: [fps[100, p] for p in range(4)], 101: [fps[100, 0], fps[100, 1]], 102: [fps[102, 0]]}
    assert sorted(r["conv"] for r in members.collect()) == [100, 101, 102, 250]


# --- operator 13 ----------------------------------------------------------------------------------
def toxic_table(n=1200):
    rnd = random.Random(9)
    plain = [f"w{i}" for i in range(400)]
    bad = ["idiot", "Scum!", "loser,", "MORON"]
    rows, labels = [], []
    for i in range(n):
        text = [plain[int(400 * rnd.random() ** 2)] for _ in range(rnd.choice([8, 30, 300]))]
        toxic = rnd.random() < 0.2
        if toxic:
            for _ in range(max(2, len(text) // 40)):
                text.insert(rnd.randrange(len(text)), rnd.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxic_texts_are_told_apart(spark):
    rows, labels = toxic_table()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.train(toxicity.labelled_texts(docs.filter(learn), spark.createDataFrame(labels, "doc_id long, toxic int")))
    scores = {r["doc_id"]: r["s"] for r in docs.select("doc_id", toxicity.score_column(F.col("text"), spark, model).alias("s")).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((scores[i] >= 0.5) == bool(labels[i][1]) for i in held)
    assert right / len(held) > 0.97 and all(0 <= s <= 1 for s in scores.values())
    odd = [None, "", "...", "ü" * 50, "idiot", "w1 " * 100_000 + "idiot scum loser moron"]
    s = model.score(odd)
    assert np.isfinite(s).all() and s[0] == s[1] == s[2] and s[4] > 0.5
    assert s[5] > model.score(["w1 " * 100_000])[0]  # a long text does not hide it


def test_probabilities_sum_to_one_and_equal_the_plain_formula(spark):
    rows, labels = toxic_table(300)
    told = toxicity.labelled_texts(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    model = toxicity.train(told)
    size = len(model.share)
    for k in (0, 1):
        assert model.single[k].sum() == pytest.approx(1)
        for v in (0, 1, 2, size // 2, size - 1):
            direct = model.direct[k][model.pairs // size == v].sum()
            assert direct + model.spare[k][v] == pytest.approx(1)
    # counts from the texts themselves
    fold = F.pmod(F.xxhash64("mark"), F.lit(toxicity.CALIBRATION_FOLDS)) == 0
    counted = [(r["text"], r["toxic"]) for r in told.filter(~fold).collect()]
    pair, after, before = [Counter(), Counter()], [defaultdict(set), defaultdict(set)], [Counter(), Counter()]
    for text, k in counted:
        ids = [0] + [model.vocab.get(w, 1) for w in words(text)] + [0]
        for v, w in zip(ids, ids[1:]):
            pair[k][v, w] += 1
            before[k][v] += 1
            after[k][w].add(v)
    n_texts = [sum(k == c for _, k in counted) for c in (0, 1)]
    types = {w: len(after[0][w] | after[1][w]) for w in range(size)}
    for k in (0, 1):
        n = Counter(pair[k].values())
        d = n[1] / (n[1] + 2 * n[2])
        m = Counter(len(x) for x in after[k].values())
        d1 = m[1] / (m[1] + 2 * m[2]) if m[1] else 0.5
        kept = {p for p in set(pair[0]) | set(pair[1]) if any(pair[c][p] >= max(2, toxicity.MIN_SHARE * n_texts[c]) for c in (0, 1))}
        whole = sum(len(x) for x in after[k].values())
        spare1 = 1 - sum(max(len(x) - d1, 0) for x in after[k].values()) / whole
        for v, w in random.Random(1).sample(sorted(kept), 40):
            shared = (types[w] + 0.5) / (sum(types.values()) + 0.5 * size)
            low = max(len(after[k][w]) - d1, 0) / whole + spare1 * shared
            spare = 1 - sum(max(pair[k][p] - d, 0) for p in kept if p[0] == v) / max(before[k][v], 1)
            want = max(pair[k][v, w] - d, 0) / max(before[k][v], 1) + spare * low
            at = np.searchsorted(model.pairs, v * size + w)
            assert model.direct[k][at] + model.spare[k][v] * model.single[k][w] == pytest.approx(want)


def test_labels_that_teach_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "x"), (3, "a b"), (4, "c"), (4, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (4, 1), (None, 1), (1, None), (1, 7)], "doc_id long, toxic int")
    got = sorted((r["text"], r["toxic"]) for r in toxicity.labelled_texts(docs, labels).collect())
    assert got == [("", 0), ("a b", 1)]  # equal texts once; 4 is labelled both ways
    assert toxicity.train(toxicity.labelled_texts(docs, labels.limit(0))) is None
    assert docs.select(toxicity.score_column(F.col("text"), spark, None).alias("s")).distinct().collect()[0]["s"] == 0.0


def test_op13_on_held_out_rows(spark):
    """About a quarter of the tables' toxic labels stand on texts that no word tells from clean ones."""
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op13_toxicity"](spark, sf).collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == 10_000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 and math.isfinite(r["score"]) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [p for p, t in held if t], [p for p, t in held if not t]
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.05
