"""Exact Jaccard join over word n-grams with prefix filters under several global orders (operator 8).

Two sets of Jaccard similarity t or more share a token among the first n - ceil(t n) + 1 tokens of
each, under *any* total order of all tokens. Three orders are used. In each, tokens known to be
frequent come last (most frequent last of all) and the others are ordered by a hash of that order's
own, so a passage that many documents share does not reach the prefixes.

1. Frequent tokens are counted over all documents (what repeats inside a task's batches, summed by
   Spark; a bounded table of the most frequent is broadcast). It only shapes the orders: any table
   gives the same result.
2. Documents of equal token sets are one node, of which one row goes on. 32 bits of each token of the first order's
   prefixes and a byte for the size of its set are dealt by hash as packed arrays; tokens that two or more nodes
   hold whose sizes permit a link are kept with their nodes (a token kept by mistake costs time only).
3. Stars: in each token's group of more than a few nodes every node is paired with some pivots of the
   group, so a group of g nodes gives a multiple of g pairs. Pairs must also share prefix tokens under the second and
   third order (the filters are intersected), and as many as a link of their two sizes must: if two sets
   have at least s tokens in common, then their prefixes of n - ceil(t n) + 1 tokens share at least
   s - ceil(t m) + 1 of them, m being the larger n. Pairs are then compared by 16-bit marks of their whole
   sets, which never miss a link, and those that pass by the sets themselves.
4. What is left are pairs of nodes in different components that share a prefix token. In small token
   groups each such pair is formed, its common tokens of the first order's prefixes are counted (what large groups may
   add is granted to it), it passes the same filters and is compared; large groups are
   cut into tiles, and a task applies the filters and the comparison to two tiles at a time and
   returns a spanning forest of the links it finds. Pairs inside a component can add nothing to the
   components, so no link that matters is lost and no large group's pairs are listed.

Nodes are 64-bit fingerprints of token sets and tokens 64-bit fingerprints of n-grams; unequal ones
are taken to differ.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskline.llm.common import drop_finished_shuffles, most_frequent, prepare, small, stored
from deskline.llm.components import components, smallest_reachable

FREQUENT = 1 << 19  # entries of the broadcast table of frequent tokens (6 MB)
COUNT_TOKENS = 1 << 21  # tokens of a counting batch (different texts only); what repeats in it is told of
STAR = 8  # nodes of a token's group up to which all its pairs are formed at once
LARGE = 64  # nodes of a token's group that are compared pair by pair; larger groups go in tiles
BUCKET_TOKENS = 1 << 21  # expected prefix tokens of one hash bucket
DEAL_TOKENS = 1 << 19  # prefix tokens of a task that are dealt at once
MARKED = 1 << 15  # sets up to this size have 16-bit marks; larger ones are compared whole at once
TILE_NODES, TILE_TOKENS = 1024, 1 << 18  # expected nodes, and tokens of their sets, of a tile
PIVOTS = (0, 0x2AAAAAAAAAAAAAAA, 0x5555555555555555, 0x3333333333333333)  # masks: each picks another member
ORDER_SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
BATCH_BYTES = 1 << 19  # text hashed at once; a longer text goes alone


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & (1 << 64) - 1, np.uint64)
    out[:1] = 1
    return np.cumprod(out)


@lru_cache(1)
def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64))


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct fingerprints of every text's ``width``-word n-grams.

    Words are what stands between blanks (bytes 9-13 and 32) after lower-casing A-Z. A word's
    fingerprint is a polynomial over its bytes, found for all words at once from running sums."""
    out: list[np.ndarray] = []
    batch: list[bytes] = []
    size = 0
    for text in texts:
        raw = (text or "").encode().lower()
        if batch and size + len(raw) > BATCH_BYTES:
            out += _shingles(batch, width)
            batch, size = [], 0
        batch.append(raw)
        size += len(raw) + 1
    return out + (_shingles(batch, width) if batch else [])


def _shingles(texts: list[bytes], width: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        change = np.concatenate([[0], change])
    begin, end = change[0::2], change[1::2]  # of words; the data ends with a blank
    n = max(len(data), BATCH_BYTES + 1)
    scale, inverse = _scales(n) if n == BATCH_BYTES + 1 else (_powers(n, _BASE), _powers(n, pow(_BASE, -1, 1 << 64)))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTES[data] * scale[:len(data)])])
    words = _mix((sums[end] - sums[begin]) * inverse[begin])
    ends = np.cumsum([len(t) + 1 for t in texts])
    cut = np.searchsorted(begin, ends)  # words of each text end here
    full = max(0, len(words) - width + 1)
    h = np.full(full, width, np.uint64)
    for i in range(width):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i:i + full])
    out, first = [], 0
    for last in cut.tolist():
        k = last - first
        if k >= width:
            out.append(np.unique(h[first:last - width + 1]))
        else:  # fewer words: the whole sequence is one n-gram; no words: none
            one = np.full(min(k, 1), k, np.uint64)
            for i in range(first, last):
                one = _mix(one * np.uint64(0x9E3779B97F4A7C15) + words[i])
            out.append(one)
        first = last
    return out


def _node(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


class Orders:
    """Prefixes of token sets under the global orders."""

    def __init__(self, frequent: np.ndarray, percent: int):
        # frequent: token fingerprints, least frequent first
        at = np.argsort(frequent)
        self.tokens, self.rank, self.percent = frequent[at], at.astype(np.int32), percent

    def prefixes(self, tokens: np.ndarray) -> list[np.ndarray]:
        """The prefix under each order."""
        size = len(tokens) - -(-self.percent * len(tokens) // 100) + 1 if len(tokens) else 0
        late = late_rank = tokens[:0]
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            hit = self.tokens[at] == tokens
            late, late_rank, tokens = tokens[hit], self.rank[at[hit]], tokens[~hit]
        if size >= len(tokens):  # the frequent ones stand in the same sequence under all orders
            return [np.concatenate([tokens, late[np.argsort(late_rank)[:size - len(tokens)]]])] * len(ORDER_SALTS)
        return [tokens[np.argpartition(_mix(tokens ^ np.uint64(salt)), size - 1)[:size]] for salt in ORDER_SALTS]


def frequent_tokens(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """Fingerprints of the tokens that repeat most over all documents, least frequent first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> pd.DataFrame:
            tokens, n = np.unique(np.concatenate(list(held.values())), return_counts=True)
            return pd.DataFrame({"token": tokens[n > 1].view(np.int64), "n": n[n > 1]})

        for batch in batches:
            for tokens in shingle_sets(batch["text"].tolist(), width):
                if len(tokens) and (node := _node(tokens)) not in held:
                    held[node] = tokens
                    size += len(tokens)
            if size >= COUNT_TOKENS:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    sums = stored(docs.select(F.col(text_col).alias("text")).mapInPandas(count, "token long, n long")
                  .groupBy("token").agg(F.sum("n").alias("n")), "frequent")
    top = most_frequent(sums, "n", FREQUENT).toArrow()
    token, n = (top.column(c).to_numpy() for c in ("token", "n"))
    return token[np.lexsort((token, n))].view(np.uint64)


def _as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def link_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
               percent: int = 80) -> DataFrame:
    """One row per input row: ``id_col``, ``n_shingles``, ``component_id``.

    Documents link when 100 * |intersection| >= ``percent`` * |union| of their sets of ``width``-word
    n-grams (a text of fewer words is one n-gram). ``component_id`` is the smallest id reachable by
    links. Null, empty and blank texts have no n-grams and are their own component. Rows that repeat
    an id or a text are rows of their own; null ids take part but never name a component.
    """
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    orders = spark.sparkContext.broadcast(Orders(frequent_tokens(own, "text", width), percent))

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = shingle_sets(batch["text"].tolist(), width)
            first, *others = zip(*map(orders.value.prefixes, sets)) if sets else ((), (), ())
            out = {"id": batch["id"], "n": [len(s) for s in sets], "node": [_node(s) if len(s) else None for s in sets],
                   "p0": [_as_long(p) for p in first]}
            for k, p in enumerate(others, 1):  # 16 bits do for a filter that may let too much through
                out[f"p{k}"] = [np.unique(x.astype(np.uint16)).view(np.int16) for x in p]
            yield pd.DataFrame(out).astype({"node": "Int64"})

    id_type = own.schema["id"].dataType.simpleString()
    tab = own.mapInPandas(prefixes, f"id {id_type}, n long, node long, p0 array<long>, p1 array<smallint>, p2 array<smallint>")
    tab = stored(tab.withColumn("row", F.monotonically_increasing_id()), "prefixes")
    links = _links(own, tab, width, percent)
    found = components(links, "a", "b")
    rows = tab.select("id", "n", "node").join(found.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
    rows = rows.select("id", "n", F.coalesce("component", "node").alias("g"))
    least = rows.filter("g IS NOT NULL").groupBy("g").agg(F.min("id").alias("least")).withColumnRenamed("g", "h")
    return rows.join(least, F.col("g") == F.col("h"), "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def _links(own: DataFrame, tab: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``a``, ``b`` between nodes whose components are those of all links."""
    # One row of each node goes on: rows that repeat a text (and an id) never meet one another.
    first = tab.filter("n > 0").groupBy("node").agg(F.min("row").alias("r"))
    first = small(stored(first.select("r"), "first_rows"))
    nodes = tab.join(first, F.col("row") == F.col("r"), "left_semi")
    # Tokens in the first order's prefixes of two nodes or more, each with its nodes.
    codes, code = _repeated(nodes.select("n", "p0"), percent)
    several = small(stored(codes, "several"))
    entries = nodes.select("node", "n", F.explode("p0").alias("token"))
    shared = stored(entries.join(several, F.expr(code) == F.col("code"), "left_semi"), "shared")
    # Tokens held by the very same nodes (near copies share dozens) tell the same: one of them stays, with their number.
    same = shared.groupBy("token").agg(F.count(F.lit(1)).alias("g"), F.min("node").alias("lo"), F.max("node").alias("hi"),
                                       F.bit_xor(F.xxhash64("node")).alias("mark")).filter("g > 1")
    same = same.groupBy("g", "lo", "hi", "mark").agg(F.min("token").alias("token"), F.count(F.lit(1)).alias("w"))
    shared = stored(shared.join(small(stored(same.select("token", "g", "w"), "tokens")), "token"), "shared")
    drop_finished_shuffles(own.sparkSession)
    standing = small(stored(shared.select("node").distinct(), "nodes"))
    slim = tab.join(standing, "node", "left_semi").join(first, F.col("row") == F.col("r"), "left_semi")
    slim = stored(slim.select("node", F.col("id").alias("i"), "n", "p1", "p2"), "slim")

    # Stars around a few pivots of the token groups that have more nodes than can be paired at once.
    starred = shared.filter(F.col("g") > STAR)
    pivots = starred.groupBy("token").agg(*[
        F.min(F.struct(F.col("node").bitwiseXOR(F.lit(m)).alias("k"), F.col("n").alias("vn"))).alias(f"v{i}")
        for i, m in enumerate(PIVOTS)])
    pivots = pivots.select("token", F.array(*[
        F.struct(F.col(f"v{i}.k").bitwiseXOR(F.lit(m)).alias("v"), F.col(f"v{i}.vn").alias("vn"))
        for i, m in enumerate(PIVOTS)]).alias("pivots"))
    stars = starred.join(pivots, "token").select("node", "n", F.explode(F.array_distinct("pivots")).alias("p"))
    stars = stars.filter(f"node <> p.v AND 100 * least(n, p.vn) >= {percent} * greatest(n, p.vn)").select(
        F.least("node", "p.v").alias("a"), F.greatest("node", "p.v").alias("b")).distinct()
    near = _verified(stars, own, slim, width, percent)

    # Pairs that still lie in different components.
    comp = components(near, "a", "b")
    comp = small(stored(comp, "near_components"))
    drop_finished_shuffles(own.sparkSession)
    placed = shared.join(comp, "node", "left").select("token", "node", "n", "g", "w", F.coalesce("component", "node").alias("c"))
    mixed = placed.groupBy("token").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("token")
    placed = stored(placed.join(small(stored(mixed, "mixed_tokens")), "token", "left_semi"), "mixed")
    few, many = placed.filter(F.col("g") <= LARGE), stored(placed.filter(F.col("g") > LARGE), "many")
    x, y = few.alias("x"), few.alias("y")
    cross = x.join(y, (F.col("x.token") == F.col("y.token")) & F.expr("x.node < y.node AND x.c <> y.c")
                   & F.expr(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"))
    cross = cross.groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("an"),
                          F.col("y.n").alias("bn")).agg(F.sum("x.w").alias("w"))
    # Large groups are not listed by pairs: a pair may share as many of their tokens as each of its nodes has.
    more = small(stored(many.groupBy("node").agg(F.sum("w").alias("more")), "in_many"))
    for side in ("a", "b"):
        cross = cross.join(more.select(F.col("node").alias(side), F.col("more").alias(f"{side}_more")), side, "left")
    in_prefix = _links_need("an", "bn", percent)[1]
    cross = cross.filter(f"w + least(coalesce(a_more, 0L), coalesce(b_more, 0L)) >= {in_prefix}").select("a", "b")
    return near.unionByName(_verified(cross, own, slim, width, percent)).unionByName(
        _tiled(many, own, slim, width, percent))


def _size_class(n, percent: int) -> np.ndarray:
    """A number below 256 for sizes of sets; those of linked sets differ by one at most."""
    step = max(-math.log(percent / 100), 0.1) * (1 + 1e-9)  # a little wide, so that rounding never makes it two
    return np.floor(np.log(np.asarray(n, dtype=np.float64)) / step).astype(np.uint8)


def _repeated(prefixes: DataFrame, percent: int) -> tuple[DataFrame, str]:
    """``code`` of the tokens in ``p0`` of two or more rows whose sizes ``n`` permit a link, and SQL for a ``token``'s code.

    A row holds a token once. A code is a token's bucket and 32 of its bits, so now and then it stands for other tokens, too.
    Tokens travel as packed arrays, one a batch and bucket, not as rows."""
    total = prefixes.agg(F.sum(F.size("p0"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_TOKENS))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        classes: list[np.ndarray] = []
        size = 0

        def flush() -> pd.DataFrame:
            tokens = np.concatenate(held).view(np.uint64)
            bucket = (tokens & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order])) + 1
            names = bucket[order][np.concatenate([[0], cut])].astype(np.int64)
            parts = [np.split(x[order], cut) for x in ((tokens >> np.uint64(32)).astype(np.uint32), np.concatenate(classes))]
            return pd.DataFrame({"bucket": names, **{k: [x.tobytes() for x in v] for k, v in zip(("tokens", "classes"), parts)}})

        for batch in batches:
            for p, k in zip(batch["p0"], _size_class(batch["n"], percent)):
                held.append(np.asarray(p, dtype=np.int64))
                classes.append(np.full(len(p), k, np.uint8))
                size += len(p)
                if size >= DEAL_TOKENS:
                    yield flush()
                    held, classes, size = [], [], 0
        if size:
            yield flush()

    def repeats(group: pd.DataFrame) -> pd.DataFrame:
        tokens = np.frombuffer(b"".join(group["tokens"]), np.uint32).astype(np.uint64) << np.uint64(8)
        tokens |= np.frombuffer(b"".join(group["classes"]), np.uint8)
        tokens.sort()
        close = (tokens[1:] - tokens[:-1] <= np.uint64(1)) & (tokens[1:] >> np.uint64(8) == tokens[:-1] >> np.uint64(8))
        found = np.unique(tokens[1:][close] >> np.uint64(8)).view(np.int64)
        return pd.DataFrame({"code": found + (int(group["bucket"].iloc[0]) << 32)})

    dealt = prefixes.mapInPandas(deal, "bucket long, tokens binary, classes binary")
    code = f"shiftleft((token & 4294967295L) % {buckets}L, 32) + shiftrightunsigned(token, 32)"
    return dealt.groupBy("bucket").applyInPandas(repeats, "code long"), code


def _tiled(many: DataFrame, own: DataFrame, slim: DataFrame, width: int, percent: int) -> DataFrame:
    """Links inside large token groups, compared tile by tile; of each pair of tiles a spanning forest.

    Nodes of a group's largest component need no comparison among themselves: the others' tiles meet
    all tiles. A tile is bounded by its nodes and by the tokens of their sets, so no task holds a whole group."""
    parts = many.groupBy("token", "c").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("size"))
    groups = parts.groupBy("token").agg(F.max(F.struct("g", "c", "size")).alias("big"), F.sum("g").alias("g"),
                                        F.sum("size").alias("size"))

    def tiles(nodes, size):
        return F.greatest(F.lit(1), F.ceil(nodes / TILE_NODES), F.ceil(size / TILE_TOKENS))

    groups = groups.select("token", F.col("big.c").alias("big"), tiles(F.col("g"), F.col("size")).alias("right_tiles"),
                           tiles(F.col("g") - F.col("big.g"), F.col("size") - F.col("big.size")).alias("left_tiles"))
    rows = many.join(groups, "token")
    left = rows.filter("c <> big").select("token", "node", F.lit(0).alias("side"), F.expr(
        "pmod(xxhash64(node, 1), left_tiles)").alias("l"),
        F.explode(F.expr("sequence(0L, right_tiles - 1)")).alias("r"))
    right = rows.select("token", "node", F.lit(1).alias("side"), F.explode(F.expr("sequence(0L, left_tiles - 1)")).alias("l"),
                        F.expr("pmod(xxhash64(node, 2), right_tiles)").alias("r"))
    dealt = left.unionByName(right)
    slim = _slim_of(slim, many.select("node"))
    whole = _sets(own, slim, width)
    dealt = dealt.join(whole.join(slim.select("node", "p1", "p2"), "node"), "node")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group["side"] == 0], group[group["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": []})
        an, bn = a["n"].to_numpy()[:, None], b["n"].to_numpy()[None, :]
        least = -(-percent * (an + bn) // (100 + percent)) + 1 + (-percent * np.maximum(an, bn) // 100)  # in prefixes
        may = np.ones(least.shape, bool)
        for p in ("p1", "p2"):
            lost = [(x["n"] + (-percent * x["n"] // 100) + 1 - x[p].map(len)).to_numpy() for x in (a, b)]
            both = _overlap(a[p], b[p])
            may &= (both > 0) & (both >= least - np.minimum(lost[0][:, None], lost[1][None, :]))
        if not may.any():
            return pd.DataFrame({"a": [], "b": []})
        both = _overlap(a["tokens"], b["tokens"])
        total = np.array([len(t) for t in a["tokens"]])[:, None] + np.array([len(t) for t in b["tokens"]])[None, :]
        an, bn = a["node"].to_numpy(), b["node"].to_numpy()
        i, j = np.nonzero(may & (100 * both >= percent * (total - both)) & (an[:, None] != bn[None, :]))
        names, place = np.unique(np.concatenate([an[i], bn[j]]), return_inverse=True)
        root = smallest_reachable(len(names), place[:len(i)], place[len(i):])
        tied = root != np.arange(len(names))
        return pd.DataFrame({"a": names[root[tied]], "b": names[tied]})

    return stored(dealt.groupBy("token", "l", "r").applyInPandas(compare, "a long, b long"), "tile_links")


def _overlap(a: pd.Series, b: pd.Series) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``, exact up to 2**24.

    Sets become rows of 0 and 1 over the tokens that both sides hold, a slice of the tokens at a time."""
    rows = [np.repeat(np.arange(len(x)), [len(t) for t in x]) for x in (a, b)]
    tokens = [np.concatenate(x.to_list()) for x in (a, b)]
    common = np.intersect1d(tokens[0], tokens[1])
    out = np.zeros((len(a), len(b)), np.float32)
    step = max(1, (8 << 20) // (len(a) + len(b)))
    for s in range(0, len(common), step):
        part = common[s:s + step]
        grid = []
        for r, t, n in zip(rows, tokens, (len(a), len(b))):
            at = np.minimum(np.searchsorted(part, t), len(part) - 1)
            ok = part[at] == t
            m = np.zeros((n, len(part)), np.float32)
            m[r[ok], at[ok]] = 1
            grid.append(m)
        out += grid[0] @ grid[1].T
    return out.astype(np.int64)


def _links_need(an: str, bn: str, percent: int) -> tuple[str, str]:
    """SQL for the tokens that linked sets of ``an`` and ``bn`` tokens have in common at least: all, and in prefixes."""
    common = f"({percent}L * ({an} + {bn}) + {99 + percent}L) div {100 + percent}L"
    return common, f"{common} - ({percent}L * greatest({an}, {bn}) + 99L) div 100L + 1L"


def _verified(pairs: DataFrame, own: DataFrame, slim: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that link: length and the other orders' prefixes are checked, then the whole sets."""
    least, in_prefix = _links_need("an", "bn", percent)

    def size(n: str) -> str:  # of a prefix
        return f"{n} - ({percent}L * {n} + 99L) div 100L + 1L"

    pairs = stored(pairs, "formed")
    near = _slim_of(slim, pairs.select(F.explode(F.array("a", "b")).alias("node")))
    # What falls together among 16-bit tokens of one prefix hides as many common ones, and no more.
    hidden = f"least({size('an')} - size(ap), {size('bn')} - size(bp))"
    for p in ("p1", "p2"):  # one filter after the other, so that few pairs carry the second one's prefixes
        left = near.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col(p).alias("ap"))
        right = near.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col(p).alias("bp"))
        pairs = pairs.join(left, "a").join(right, "b").filter(
            f"100 * least(an, bn) >= {percent} * greatest(an, bn) AND arrays_overlap(ap, bp) "
            f"AND size(array_intersect(ap, bp)) >= {in_prefix} - {hidden}").select("a", "b")
    pairs = stored(pairs, "pairs")
    drop_finished_shuffles(own.sparkSession)
    whole = _sets(own, _slim_of(near.select("node", "i"), pairs.select(F.explode(F.array("a", "b")).alias("node"))), width)
    # Links have at least ``least`` tokens in common. Marks that fall together inside a set hide as many of them.
    left = whole.select(F.col("node").alias("a"), F.col("n").alias("an"), F.col("marks").alias("am"))
    right = whole.select(F.col("node").alias("b"), F.col("n").alias("bn"), F.col("marks").alias("bm"))
    hidden = F.least(F.col("an") - F.size("am"), F.col("bn") - F.size("bm"))
    may = F.size(F.array_intersect("am", "bm")) >= F.expr(least) - hidden
    pairs = stored(pairs.join(left, "a").join(right, "b").filter(F.coalesce(may, F.lit(True))).select("a", "b"), "marked")
    passed = small(stored(pairs.select(F.explode(F.array("a", "b")).alias("m")).distinct(), "passed"))
    whole = whole.join(passed, F.col("node") == F.col("m"), "left_semi")  # only these sets are moved
    left = whole.select(F.col("node").alias("a"), F.col("tokens").alias("at"))
    right = whole.select(F.col("node").alias("b"), F.col("tokens").alias("bt"))
    both = pairs.join(left, "a").join(right, "b").select(
        "a", "b", (F.size("at") + F.size("bt")).alias("sum"), F.size(F.array_intersect("at", "bt")).alias("common"))
    return stored(both.filter(f"100L * common >= {percent}L * (sum - common)").select("a", "b"), "links")


def _slim_of(slim: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``slim`` whose ``node`` is in ``nodes``, stored: only these are moved by joins."""
    wanted = small(stored(nodes.select(F.col("node").alias("m")).distinct(), "wanted"))
    return stored(slim.join(wanted, F.col("node") == F.col("m"), "left_semi"), "slim")


def _sets(own: DataFrame, slim: DataFrame, width: int) -> DataFrame:
    """``node``, ``n``, ``tokens`` and their 16-bit ``marks`` (null for large sets) of the nodes in ``slim``, each once."""
    ids, wanted = small(slim.select("i").distinct()), small(slim.select(F.col("node").alias("m")))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()  # of the task
        for batch in batches:
            new = {}
            for s in shingle_sets(batch["text"].tolist(), width):
                if len(s) and (node := _node(s)) not in seen:
                    seen.add(node)
                    new[node] = s
            if new:
                yield pd.DataFrame({
                    "node": list(new), "n": [len(s) for s in new.values()], "tokens": [_as_long(s) for s in new.values()],
                    "marks": [np.unique(_mix(s).astype(np.uint16)).view(np.int16) if len(s) <= MARKED else None for s in new.values()]})

    texts = own.join(ids, F.col("id").eqNullSafe(F.col("i")), "left_semi").select("text")
    found = texts.mapInPandas(sets, "node long, n long, tokens array<long>, marks array<smallint>")
    # Ids that repeat bring other texts, and tasks that met one text its set once each: the first one stays.
    # Such rows are told by narrow numbers; the sets themselves are not dealt anew.
    found = found.join(wanted, F.col("node") == F.col("m"), "left_semi").withColumn("row", F.monotonically_increasing_id())
    found = stored(found, "sets")
    again = found.groupBy("node").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    again = small(stored(again.select(F.col("node").alias("twice"), "first"), "twice"))
    return found.join(again, F.col("node") == F.col("twice"), "left").filter("first IS NULL OR row = first").drop("row", "twice", "first", "k")
