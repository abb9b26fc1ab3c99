"""op8: nodes whose sizes permit no link with another holder of their tokens, and pairs with too few common
prefix tokens, are left out before prefixes and sets are moved; linked sets never are."""

import numpy as np
import pytest

from deskline.llm import jaccard_join
from tests.llm.test_queries import jaccard_components

DOCS = "doc_id long, text string"


def words(first, n):
    return [f"w{first + i}" for i in range(n)]


@pytest.mark.parametrize("percent", [20, 50, 70, 80, 85, 99, 100])
def test_size_classes_of_linked_sets_are_neighbours(percent):
    n = np.concatenate([np.arange(1, 3000), [1 << k for k in range(12, 31)]])
    largest = 100 * n // percent  # a link's larger set has as many tokens at most
    a, b = (jaccard_join._size_class(x, percent).astype(int) for x in (n, largest))
    assert ((b - a >= 0) & (b - a <= 1)).all()


def test_texts_that_share_a_passage_by_chance_are_not_moved(spark, monkeypatch):
    moved = []
    verified = jaccard_join._verified

    def watched(pairs, own, slim, width, percent):
        moved.append((slim.count(), pairs.count()))
        return verified(pairs, own, slim, width, percent)

    monkeypatch.setattr(jaccard_join, "_verified", watched)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0)  # every shared token may stand in a prefix
    passage = words(0, 5)
    texts = {}
    for i in range(6):  # one passage in texts of very different sizes
        texts[i] = " ".join(passage + words(1000 * (i + 1), 6 * 3 ** min(i, 4) + 400 * (i == 5)))
    for i in range(10, 16, 2):  # near copies, with one word changed
        body = words(100_000 * i, 200)
        texts[i], texts[i + 1] = " ".join(body), " ".join([*body[:-1], "other"])
    for i in range(20, 26):  # texts of one size, a passage of thirty words in common
        texts[i] = " ".join(words(50_000, 30) + words(100_000 * i, 170))
    docs = spark.createDataFrame(list(texts.items()), DOCS).repartition(3)
    out = jaccard_join.link_table(docs, width=3, percent=80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()}
    assert got == jaccard_components(texts, 3, 80)
    assert [got[i][1] for i in range(10, 16)] == [10, 10, 12, 12, 14, 14]
    assert max(n for n, _ in moved) <= 12  # none of the first six
    assert moved[-1][1] <= 3 + 3  # near copies, not all pairs of the last six (the prefix counts differ by text)
