"""Scoring documents with a gated recurrent language model (operator 3).

1. Token counts of all training documents are gathered with a Spark aggregate.
2. The most frequent tokens become symbols of the model; every other token is told by its *ending*
   (a hash of its last two bytes) as one of ``ENDINGS`` further symbols, and inside an ending by its
   smoothed share of that ending's counts. So the model gives a probability to every text.
3. Training runs in ``ROUNDS``: each training document belongs to one round by its hash; every task
   runs truncated backpropagation over its documents of the round from the same parameters, and the
   tasks' results are averaged by Spark, weighted by tokens. All training documents are learned from.
4. Scoring carries the state through each whole document.

Counts of the ``HOT`` most frequent tokens are broadcast (bounded); those of all others meet their
documents in a shuffle join, so the unigram base score is exact and nothing that grows with the data
is broadcast or collected.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.llm import gru
from deskline.llm.common import most_frequent, prepare, stored

HOT = 1 << 18  # tokens whose counts every task holds
ENDINGS = 64  # symbols for tokens that are not symbols themselves
ROUNDS = 3
COUNTED = 300_000  # distinct tokens a task counts before it passes them on
ADD = 0.1  # smoothing of the base model
END = b" "  # the closing token; no word holds a blank


def words(text: str | None) -> list[bytes]:
    """What stands between blanks (bytes 9-13 and 32) after lower-casing A-Z."""
    return (text or "").encode().lower().split()


def _ending(token: bytes) -> int:
    return zlib.crc32(token[-2:]) % ENDINGS


def token_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """``token`` (binary), ``c`` and ``ending``, over all rows; the closing token counts once a row."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(words(text))
            held[END] += len(batch)
            if len(held) > COUNTED:
                yield pd.DataFrame({"token": list(held), "c": list(held.values())})
                held = Counter()
        if held:
            yield pd.DataFrame({"token": list(held), "c": list(held.values())})

    sums = (docs.select(F.col(text_col).alias("text")).mapInPandas(count, "token binary, c long")
            .groupBy("token").agg(F.sum("c").alias("c")).filter("c > 0"))
    tail = F.substring("token", -2, 2)
    return stored(sums.withColumn("ending", (F.crc32(F.when(F.octet_length("token") < 2, F.col("token")).otherwise(tail))
                                             % ENDINGS).cast("int")), "token_counts")


class Vocabulary:
    """Symbols, hot tokens and the totals that probabilities need. Its size is bounded by HOT."""

    def __init__(self, hot: list[tuple[bytes, int]], totals: dict[int, tuple[int, int]]):
        # hot: tokens by falling count; totals: ending -> (count, distinct) over all tokens
        self.n = sum(c for c, _ in totals.values())
        self.distinct = sum(d for _, d in totals.values())
        own = [t for t, _ in hot if t != END][:gru.SYMBOLS - ENDINGS - 1]
        known = dict(hot)
        # symbols by falling frequency: words, the closing token and the endings
        rest = {e: list(totals.get(e, (0, 0))) for e in range(ENDINGS)}
        for t in [*own, *([END] if END in known else [])]:
            rest[_ending(t)][0] -= known[t]
            rest[_ending(t)][1] -= 1
        frequency = [(c, "w", t) for t, c in hot if t in set(own)] + [(known.get(END, 0), "x", END)]
        frequency += [(rest[e][0], "e", bytes([e])) for e in range(ENDINGS)]
        frequency.sort(key=lambda x: (-x[0], x[1], x[2]))
        self.frequency = np.zeros(gru.SYMBOLS)
        self.frequency[:len(frequency)] = [f[0] for f in frequency]
        number = {(kind, name): i for i, (_, kind, name) in enumerate(frequency)}
        self.end = number["x", END]
        self.ending_symbol = np.array([number["e", bytes([e])] for e in range(ENDINGS)], dtype=np.int16)
        # log10 of what a token's count is divided by inside its ending (one share for unseen tokens)
        self.ending_log = np.array([math.log10(rest[e][0] + ADD * (rest[e][1] + 1)) for e in range(ENDINGS)])
        self.base_log = math.log10(self.n + ADD * (self.distinct + 1))
        self.place = {t: i for i, (t, _) in enumerate(hot)}
        counts = np.array([c for _, c in hot], dtype=np.float64)
        self.count_log = np.log10(counts + ADD)
        symbol = [number.get(("x" if t == END else "w", t), -1) for t, _ in hot]
        self.symbol = np.array([s if s >= 0 else self.ending_symbol[_ending(t)] for s, (t, _) in zip(symbol, hot)], dtype=np.int16)
        inside = np.array([0.0 if s >= 0 else self.ending_log[_ending(t)] for s, (t, _) in zip(symbol, hot)])
        self.inside_log = np.where(np.array(symbol, dtype=int) >= 0, 0.0, self.count_log - inside) if hot else inside
        self.end_log = math.log10(known.get(END, 0) + ADD)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """HOT rows and ENDINGS totals reach the driver."""
    top = most_frequent(counts.select("token", "c"), "c", HOT).toArrow()
    hot = list(zip(top.column("token").to_pylist(), top.column("c").to_pylist()))
    hot.sort(key=lambda x: (-x[1], x[0]))
    if not any(t == END for t, _ in hot):  # an end is a symbol whatever its rank
        hot += [(END, r["c"]) for r in counts.filter(F.col("token") == F.lit(END)).collect()]
    totals = {r["ending"]: (r["c"], r["d"]) for r in counts.groupBy("ending").agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("d")).collect()}
    return Vocabulary(hot, totals)


SYMBOL_ROWS = ("row long, id {}, held_out boolean, round int, n_tokens long, n_hot long, base double, inside double, "
               "symbols binary, cold array<binary>")


def symbol_table(docs: DataFrame, vocab, id_col: str, text_col: str, held_out: Column) -> DataFrame:
    """One row per document: its symbols (16-bit numbers), its logs from hot tokens and its other tokens."""

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = vocab.value
        get = v.place.get
        for batch in batches:
            out = {k: [] for k in ("n_tokens", "n_hot", "base", "inside", "symbols", "cold")}
            for text in batch["text"]:
                tokens = words(text)
                at = np.array([get(t, -1) for t in tokens], dtype=np.int32)
                cold = np.flatnonzero(at < 0)
                hot = at[at >= 0]
                symbols = np.empty(len(at) + 1, np.int16)
                if len(hot):
                    symbols[:-1] = v.symbol[at]
                inside = float(v.inside_log[hot].sum())
                if len(cold):
                    endings = np.array([_ending(tokens[i]) for i in cold])
                    symbols[cold] = v.ending_symbol[endings]
                    inside -= float(v.ending_log[endings].sum())
                symbols[-1] = v.end
                out["n_tokens"].append(len(symbols))
                out["n_hot"].append(len(hot))
                out["base"].append(float(v.count_log[hot].sum()) + v.end_log - len(symbols) * v.base_log)
                out["inside"].append(inside)
                out["symbols"].append(symbols.tobytes())
                out["cold"].append([tokens[i] for i in cold])
            yield pd.DataFrame({**{k: batch[k] for k in ("row", "id", "held_out", "round")}, **out})

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held_out.alias("held_out"),
                      F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(ROUNDS)).cast("int").alias("round"),
                      F.col(text_col).alias("text"))
    return stored(own.mapInPandas(convert, SYMBOL_ROWS.format(own.schema["id"].dataType.simpleString())), "symbols")


def _texts(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(raw, np.int16) for raw in column]


def train(symbols: DataFrame, frequency: np.ndarray, end: int) -> dict[str, np.ndarray]:
    """Averaged parameters after all rounds; as many numbers as the model has reach the driver a round."""
    spark = symbols.sparkSession
    params = gru.initial(frequency)
    for number in range(ROUNDS):
        start = spark.sparkContext.broadcast(gru.flat(params))
        rate = gru.RATE * (1 - number / (ROUNDS + 1))

        def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model, tokens, held, size = gru.Trainer(gru.unflat(start.value), rate), 0, [], 0
            for batch in batches:
                held += (texts := _texts(batch["symbols"]))
                size += sum(map(len, texts))
                if size >= gru.TRAIN_TOKENS:
                    model.learn(held, end)
                    tokens, held, size = tokens + size, [], 0
            if held:
                model.learn(held, end)
                tokens += size
            if tokens:
                v = gru.flat(model.p).astype(np.float64)
                yield pd.DataFrame({"at": np.arange(len(v)), "v": v * tokens, "w": tokens})

        rows = (symbols.filter((F.col("round") == number) & ~F.col("held_out")).select("symbols")
                .mapInPandas(learn, "at int, v double, w long").groupBy("at")
                .agg((F.sum("v") / F.sum("w")).alias("v")).toArrow())
        if len(rows):
            params = gru.unflat(rows.column("v").to_numpy()[np.argsort(rows.column("at").to_numpy())])
    return params


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Rows where ``held_out`` is false are learned from. A null or empty text is the closing token alone.
    ``base_score`` is the add-0.1 unigram score and ``score`` the model's log10 probability of the
    text; a token that was never learned from counts as unseen in both. With nothing to learn from,
    every token is unseen and the model is its first state. Rows that repeat an id are rows of their own.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    counts = token_counts(docs.filter(~held_out), text_col)
    vocab = vocabulary(counts)
    symbols = symbol_table(docs, spark.sparkContext.broadcast(vocab), id_col, text_col, held_out)
    params = spark.sparkContext.broadcast(gru.flat(train(symbols, vocab.frequency, vocab.end)))
    end = vocab.end

    def model(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = gru.unflat(params.value)
        rows, held, size = [], [], 0

        def flush() -> pd.DataFrame:
            logs = gru.score(p, held, end) / math.log(10)
            return pd.concat(rows, ignore_index=True).assign(model=logs)

        for batch in batches:
            held += (texts := _texts(batch["symbols"]))
            rows.append(batch[keep])
            size += sum(map(len, texts))
            if size >= gru.SCORE_TOKENS:
                yield flush()
                rows, held, size = [], [], 0
        if rows:
            yield flush()

    keep = ["row", "id", "held_out", "n_tokens", "n_hot", "base", "inside"]
    kind = symbols.schema["id"].dataType.simpleString()
    told = symbols.select(*keep, "symbols").mapInPandas(
        model, f"row long, id {kind}, held_out boolean, n_tokens long, n_hot long, base double, inside double, model double")
    # Tokens beyond the hot ones: their counts come by a join.
    cold = symbols.select("row", F.explode("cold").alias("token")).join(counts.select("token", "c"), "token", "left")
    cold = cold.groupBy("row").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(ADD))).alias("logs"),
                                   F.count("c").alias("n_cold")).withColumnRenamed("row", "r")
    logs = F.coalesce("logs", F.lit(0.0))
    end_known = 1 if vocab.n else 0
    return told.join(cold, F.col("row") == F.col("r"), "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_hot") + F.coalesce("n_cold", F.lit(0)) + end_known).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"),
        (F.col("model") + F.col("inside") + logs).alias("score"))
