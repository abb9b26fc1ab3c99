"""Language identification by multinomial naive Bayes over hashed character n-grams (operator 7).

Training counts n-grams by language inside every task (numpy), sums them with a Spark aggregate and
turns them into one log-probability matrix of buckets x languages, which is broadcast: its size is
fixed by ``BUCKETS`` and ``MAX_LANGS``. Scoring hashes the n-grams of a batch of whole texts at
once, gathers their matrix rows and sums them document by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.llm.common import prepare

BITS = 15
BUCKETS = 1 << BITS  # hashed n-grams
ORDERS = (2, 3)  # n-gram lengths
MAX_LANGS = 256  # rows of the matrix: 64 MB at most
ALPHA = 0.5  # added to every count
BATCH_CHARS = 1 << 18  # characters hashed at once; a longer text goes alone


@lru_cache(1)
def _letters() -> np.ndarray:
    """True for code points of a letter category (lower-cased texts are looked up)."""
    import unicodedata

    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram of the texts, the number of its text, and which texts hold a letter.

    Texts are lower-cased; each run of other characters than letters counts as one blank, and a
    blank stands before and after the text. N-grams never cross texts.
    """
    low = [t.lower() for t in texts]
    lengths = np.array([len(t) for t in low], dtype=np.int64)
    points = np.frombuffer(" ".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    # owner: the blank before a text belongs to it; the last blank closes the last text
    owner = np.append(np.repeat(np.arange(len(texts), dtype=np.int32), lengths + 1), np.int32(len(texts)))
    lead = np.zeros(len(points), bool)
    lead[np.cumsum(lengths + 1) - lengths - 1] = True
    lead[-1] = True
    letter = _letters()[points]
    has_letter = np.bincount(owner[letter], minlength=len(texts)) > 0
    keep = letter | lead
    keep[1:] |= letter[:-1]  # the first of a run of other characters
    points, owner, lead = np.where(letter, points, np.uint32(0x20))[keep], owner[keep], lead[keep]
    keep = lead | (points != 0x20)
    keep[:-1] |= ~lead[1:]  # a run at the end of a text is the blank after it
    points, owner, lead = points[keep], owner[keep], lead[keep]
    ids, docs = [], []
    for n in ORDERS:
        m = len(points) - n + 1
        if m < 1:
            continue
        h = np.full(m, 0x9E37 * n + 1, np.uint32)
        for k in range(n):
            h = (h ^ points[k:k + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(13)
        h = (h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
        # the blank that opens a text also closes the one before
        inside = (owner[:m] == owner[n - 2:n - 2 + m]) & ~(lead[:m] & lead[1:m + 1])
        ids.append(h[inside])
        docs.append(owner[:m][inside])
    if not ids:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), has_letter
    return np.concatenate(ids), np.concatenate(docs), has_letter


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_CHARS:
            yield begin, i
            begin, size = i, 0
        size += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


@dataclass
class Model:
    langs: list[str]
    matrix: np.ndarray  # buckets x languages, log probability
    prior: np.ndarray  # log share of the training documents

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text; ('und', 0.0) without a letter."""
        names, probs = [], []
        for a, b in _batches(texts):
            ids, docs, has_letter = ngram_buckets(texts[a:b])
            total = np.tile(self.prior, (b - a, 1))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(docs, self.matrix[ids, k], b - a)
            best = total.argmax(1) if self.langs else np.zeros(b - a, int)
            for i in range(b - a):
                if not self.langs or not has_letter[i]:
                    names.append("und")
                    probs.append(0.0)
                else:
                    names.append(self.langs[best[i]])
                    probs.append(float(1.0 / np.exp(total[i] - total[i, best[i]]).sum()))
        return names, np.array(probs, dtype=np.float64)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count the n-grams of every row with a language (null texts count as empty).

    Without labelled rows the model knows no language and calls every text ``und``. More than
    ``MAX_LANGS`` languages raise ValueError: the matrix must stay of a bounded size."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32) - 1, "n": n[at]})
            held.clear()

        for batch in batches:
            for lang, texts in batch.groupby("lang", sort=False)["text"]:
                if lang not in held and len(held) >= MAX_LANGS:
                    yield from flush()
                n = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                texts = ["" if t is None else t for t in texts]
                n[0] += len(texts)  # bucket -1: documents
                for a, b in _batches(texts):
                    n[1:] += np.bincount(ngram_buckets(texts[a:b])[0], minlength=BUCKETS)
        yield from flush()

    rows = (docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL")
            .mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    # (MAX_LANGS + 1) x (BUCKETS + 1) rows reach the driver at most, however large the input
    got = rows.limit((MAX_LANGS + 1) * (BUCKETS + 1)).toArrow().to_pandas()
    langs = sorted(got["lang"].unique())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    counts = np.full((BUCKETS, len(langs)), ALPHA)
    seen = np.zeros(len(langs))
    col = got["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(dtype=int) if len(got) else np.zeros(0, int)
    bucket, n = got["bucket"].to_numpy(), got["n"].to_numpy()
    seen[col[bucket < 0]] = n[bucket < 0]
    counts[bucket[bucket >= 0], col[bucket >= 0]] += n[bucket >= 0]
    matrix = np.log(counts) - np.log(counts.sum(0, keepdims=True)) if langs else counts
    return Model([str(x) for x in langs], matrix, np.log(seen / seen.sum()) if langs else seen)


def predict_column(text: Column, spark, model: Model) -> Column:
    """Struct ``lang_pred`` (a learned language, or ``und`` for null and letterless texts) and ``score``."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, probs = held.value.score(["" if t is None else t for t in batch])
            yield pd.DataFrame({"lang_pred": names, "score": probs})

    return predict(text)
