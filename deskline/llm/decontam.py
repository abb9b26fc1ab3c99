"""Benchmark decontamination by a prefix-filtered set join (operator 5).

Every benchmark item is cut into windows of ``width`` consecutive words. A window occurs in a
document if all its word shingles do, one after another. The steps:

1. One pass over the documents finds every position where a benchmark shingle occurs (numpy over
   word numbers; only benchmark words have numbers) and keeps one narrow row a document.
2. Shingles are ordered by rarity: how many documents hold them, counted by Spark over all rows.
3. Containment asks for all of a window's shingles, so one is a sufficient prefix: the rarest.
   Each window is indexed by that shingle and the shingle's offset inside it.
4. Joining a document's shingles with that index gives candidate windows with their only possible
   start (positional bound), which must leave room for the window in the document (length bound).
5. Candidates are verified word for word (shingle numbers are exact, no hashes) and their words
   are counted as hit.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words, so what is broadcast has a bound
whatever the benchmark's size; more blocks mean more passes over the documents. With more than one
block every document row first gets a stored number of its own, by which the blocks' results are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskline.llm.common import prepare, stored

SHINGLE = 3  # words of a shingle (fewer in windows of fewer words)
BLOCK_WORDS = 1 << 20  # benchmark words held at once
BATCH_CHARS = 1 << 21

#: Lower-cases A-Z and turns every ASCII byte that is neither a letter nor a digit into a blank.
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Runs of digits, lower-cased letters and non-ASCII characters, as UTF-8."""
    return (text or "").encode().translate(_TO_WORDS).split()


class Benchmark:
    """Word numbers, shingle numbers and windows of one block of items."""

    def __init__(self, items: list[tuple], width: int):
        self.vocab: dict[bytes, int] = {}
        texts = [[self.vocab.setdefault(w, len(self.vocab)) for w in words(t)] for _, t in items]
        seen: dict[tuple, int] = {}  # window -> number
        self.owners: list[set[int]] = []
        for i, text in enumerate(texts):
            for s in range(max(1, len(text) - width + 1) if text else 0):
                at = seen.setdefault(tuple(text[s:s + width]), len(seen))
                if at == len(self.owners):
                    self.owners.append(set())
                self.owners[at].add(i)
        self.windows = [np.array(w, dtype=np.int64) for w in seen]
        self.ids = [i for i, _ in items]
        self.base = len(self.vocab) + 1
        if self.base ** SHINGLE >= 1 << 62:
            raise ValueError("a block of the benchmark holds too many distinct words")
        # A shingle's number is its place among the sorted codes of its width.
        self.codes: dict[int, np.ndarray] = {}
        for k in sorted({min(SHINGLE, len(w)) for w in self.windows}):
            of = [self.code(w, k) for w in self.windows if min(SHINGLE, len(w)) == k]
            self.codes[k] = np.unique(np.concatenate(of))
        self.shingles = [self.codes[k].searchsorted(self.code(w, k)) * 4 + k
                         for w in self.windows for k in (min(SHINGLE, len(w)),)]

    def code(self, numbers: np.ndarray, k: int) -> np.ndarray:
        """Exact code of every k words in a row; negative where a word has no number."""
        n = max(0, len(numbers) - k + 1)
        out, bad = np.zeros(n, np.int64), np.zeros(n, bool)
        for i in range(k):
            part = numbers[i:i + n]
            out = out * self.base + part + 1
            bad |= part < 0
        out[bad] = -1
        return out


def find_shingles(docs: DataFrame, bench, id_col: str, text_col: str) -> DataFrame:
    """``row``, ``id``, ``n_words``, ``at`` and ``shingle``: where benchmark shingles occur, one row a document."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = bench.value
        get = block.vocab.get
        for batch in batches:
            ids, texts, out = batch["id"], batch["text"].tolist(), []
            begin, size = 0, 0
            for i in range(len(texts) + 1):
                if i < len(texts) and size < BATCH_CHARS:
                    size += len(texts[i] or "")
                    continue
                out += _positions(texts[begin:i], block, get)
                begin, size = i, len(texts[i] or "") if i < len(texts) else 0
            n, at, shingle = zip(*out) if out else ((), (), ())
            yield pd.DataFrame({"row": batch["row"], "id": ids, "n_words": list(n), "at": pd.Series(list(at), index=ids.index, dtype=object),
                                "shingle": pd.Series(list(shingle), index=ids.index, dtype=object)})

    own = docs.select("row", F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInPandas(find, f"row long, id {kind}, n_words long, at array<int>, shingle array<int>")


def _positions(texts: list[str], block: Benchmark, get) -> list[tuple[int, np.ndarray, np.ndarray]]:
    split = [words(t) for t in texts]
    lengths = np.array([len(w) + 1 for w in split], dtype=np.int64)
    numbers = np.full(int(lengths.sum()) + SHINGLE, -1, np.int64)  # -1 also parts the texts
    starts = np.cumsum(lengths) - lengths
    for s, w in zip(starts.tolist(), split):
        numbers[s:s + len(w)] = [get(x, -1) for x in w]
    hits, names = [], []
    for k, codes in block.codes.items():
        code = block.code(numbers, k)
        some = np.flatnonzero(code >= 0)
        place = np.minimum(codes.searchsorted(code[some]), len(codes) - 1)
        ok = codes[place] == code[some]
        hits.append(some[ok])
        names.append(place[ok] * 4 + k)
    at = np.concatenate(hits) if hits else np.zeros(0, np.int64)
    name = np.concatenate(names) if names else np.zeros(0, np.int64)
    order = np.argsort(at, kind="stable")
    at, name = at[order], name[order]
    cut = at.searchsorted(np.append(starts, starts[-1] + lengths[-1]) if len(starts) else [0])
    return [(int(n) - 1, (at[a:b] - s).astype(np.int32), name[a:b].astype(np.int32))
            for n, s, a, b in zip(lengths, starts, cut, cut[1:])]


def _index(bench: Benchmark, rarity: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
    """Rarest shingle -> (window, the shingle's offset in it); windows no document can hold are left out."""
    out: dict[int, list[tuple[int, int]]] = {}
    for w, shingles in enumerate(bench.shingles):
        counts = [rarity.get(s, 0) for s in shingles.tolist()]
        least = min(range(len(counts)), key=lambda j: (counts[j], shingles[j]))
        if counts[least]:
            out.setdefault(int(shingles[least]), []).append((w, least))
    return out


def _verify(at: np.ndarray, shingle: np.ndarray, n_words: int, bench: Benchmark, index: dict) -> tuple[list, set]:
    """Spans (start, end) of the windows that occur in one document, and the numbers of their items."""
    spans, items = [], set()
    place = {}
    for p, s in zip(at.tolist(), shingle.tolist()):
        place[p, s & 3] = s
    for (p, k), s in place.items():
        for window, offset in index.get(s, ()):
            start, length = p - offset, len(bench.windows[window])
            if start < 0 or start + length > n_words:
                continue
            if all(place.get((start + j, k)) == x for j, x in enumerate(bench.shingles[window].tolist())):
                spans.append((start, start + length))
                items |= bench.owners[window]
    return spans, items


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_id: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """One row per document: id, ``n_words``, ``spans`` (word positions, end exclusive, merged),
    ``n_hit`` (words inside them) and ``item_ids`` (items with a window in the document, as sorted strings).

    Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. An item of fewer
    than ``width`` words is one window; items without words, null texts and an empty benchmark hit
    nothing. Rows that repeat an id and rows without one are rows of their own, whatever the benchmark's
    size. Extra columns of either table are ignored.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    found = None
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    blocks = _blocks(items, item_id, item_text)
    block, after = next(blocks), next(blocks, None)
    own = own.withColumn("row", F.monotonically_increasing_id())
    if after is not None:  # a number must be the same row's in every pass
        own = stored(own, "numbered")
    while block is not None:
        bench = spark.sparkContext.broadcast(Benchmark(block, width))
        part = stored(find_shingles(own, bench, "id", "text"), "shingles")
        counts = (part.filter("size(shingle) > 0").select(F.explode(F.array_distinct("shingle")).alias("s"))
                  .groupBy("s").agg(F.count(F.lit(1)).alias("n")))
        # as many rows as the block has shingles at most
        rarity = {r["s"]: r["n"] for r in counts.toLocalIterator()}
        part = _hits(part, bench, spark.sparkContext.broadcast(_index(bench.value, rarity)))
        found = part if found is None else stored(_merged(found, part), "merged")
        block, after = after, next(blocks, None)
    return found.select(F.col("id").alias(id_col), "n_words", "spans",
                        F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)").alias("n_hit"), "item_ids")


def _blocks(items: DataFrame, item_id: str, item_text: str) -> Iterator[list[tuple]]:
    """Items in blocks of at most BLOCK_WORDS words (or one item); one empty block for no items."""
    held, size, any_block = [], 0, False
    for row in items.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).toLocalIterator():
        n = len(words(row["t"]))
        if held and size + n > BLOCK_WORDS:
            yield held
            held, size, any_block = [], 0, True
        if n:
            held.append((row["i"], row["t"]))
            size += n
    if held or not any_block:
        yield held


HITS = "n_words long, spans array<struct<start:int,stop:int>>, item_ids array<string>"


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _hits(part: DataFrame, bench, index) -> DataFrame:
    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, prefix = bench.value, index.value
        for batch in batches:
            spans, names = [], []
            for at, shingle, n in zip(batch["at"], batch["shingle"], batch["n_words"]):
                got, items = _verify(at, shingle, n, block, prefix) if len(at) else ([], set())
                spans.append([{"start": a, "stop": b} for a, b in _union(got)])
                names.append(sorted({block.ids[i] for i in items if block.ids[i] is not None}))
            yield pd.DataFrame({"row": batch["row"], "id": batch["id"], "n_words": batch["n_words"],
                                "spans": pd.Series(spans, index=batch.index, dtype=object),
                                "item_ids": pd.Series(names, index=batch.index, dtype=object)})

    kind = part.schema["id"].dataType.simpleString()
    return part.mapInPandas(join, f"row long, id {kind}, {HITS}")


def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Results of benchmark blocks for the same documents, put together: one row of each side a group."""

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["spans"] = [[{"start": x, "stop": y} for x, y in _union([(s["start"], s["stop"]) for s in p])]
                              for p in batch["spans"]]
            yield batch

    both = a.unionByName(b).groupBy("row").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    kind = a.schema["id"].dataType.simpleString()
    return both.mapInPandas(put, f"row long, id {kind}, {HITS}")
