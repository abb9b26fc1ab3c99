"""Byte-level BPE encoding and decoding (operator 10).

Text becomes an array of code points, code points become classes, and the pre-tokeniser is a small
automaton over classes. A class acts on the automaton as a function from states to states; those
functions compose associatively, so block composites are looked up in the table of the (finite)
set of composed functions and all blocks are then run side by side. The resulting slices go
through pair merging once per distinct slice of a task (a bounded cache); ids are kept with the
byte offset where each token begins, and decoding is a lookup of token bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskline.llm.common import prepare

#: The code points of the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
               0x202F, 0x205F, 0x3000]
#: What may follow an apostrophe as a contraction.
SHORT_TAILS, LONG_TAILS = "stmd", ["re", "ve", "ll"]

END = 0x110000  # stands between texts
CACHE_ENTRIES = 150_000  # distinct slices of each generation that a worker keeps
CACHE_SLICE = 64  # longer slices are merged anew each time
BLOCK_CHARS = 1 << 19  # code points scanned at once; a longer text is scanned alone

# Classes of the automaton.
LETTER, NUMBER, OTHER, QUOTE2, QUOTE3, SPACE_RUN, SPACE_JOIN, SPACE_LONE, BREAK = range(9)
# States: nothing open, in letters, numbers, others, white space, one joinable blank, contraction tails.
FRESH, IN_L, IN_N, IN_O, IN_W, JOIN, TAIL1, TAIL2 = range(8)


def _step(state: int, cls: int) -> tuple[int, bool]:
    """The automaton: next state, and whether a slice begins before this code point."""
    if cls in (LETTER, NUMBER):
        if cls == LETTER and state in (TAIL1, TAIL2):
            return (FRESH, False) if state == TAIL1 else (TAIL1, False)
        own = IN_L if cls == LETTER else IN_N
        return own, state not in (own, JOIN)
    if cls in (OTHER, QUOTE2, QUOTE3):
        if state in (IN_O, JOIN):
            return IN_O, False
        return {OTHER: IN_O, QUOTE2: TAIL1, QUOTE3: TAIL2}[cls], True
    if cls == SPACE_RUN:
        return IN_W, state != IN_W
    return {SPACE_JOIN: JOIN, SPACE_LONE: FRESH, BREAK: FRESH}[cls], True


@lru_cache(1)
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Functions of the classes (element numbers), the composition table, what each element does to
    each state, and the boundary flag by (state, class)."""
    start = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    elements = list(dict.fromkeys([tuple(range(8)), *start]))
    seen = {f: i for i, f in enumerate(elements)}
    for f in elements:  # grows while it is walked: the closure under composition
        for g in start:
            if (h := tuple(g[s] for s in f)) not in seen:
                seen[h] = len(elements)
                elements.append(h)
    table = np.array([[seen[tuple(g[s] for s in f)] for g in elements] for f in elements], dtype=np.uint16)
    flags = np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)])
    return (np.array([seen[f] for f in start], dtype=np.uint16), table,
            np.array(elements, dtype=np.uint8), flags)


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE_RUN (any white space) for every code point, BREAK for END."""
    import unicodedata

    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(END)), np.uint8, END)
    out[WHITE_SPACE] = SPACE_RUN
    return np.append(out, np.uint8(BREAK))


def boundaries(points: np.ndarray) -> np.ndarray:
    """Boolean array: a slice begins before this code point. ``points`` ends with END; every END is
    a slice of its own."""
    cls = _classes()[points]
    after, after2 = np.append(points[1:], END), np.append(points[2:], [END, END])[:len(points)]
    white, next_cls = cls == SPACE_RUN, np.append(cls[1:], BREAK)
    alone = white & (next_cls != SPACE_RUN) & (next_cls != BREAK)
    cls[alone] = np.where(points[alone] == 0x20, SPACE_JOIN, SPACE_LONE)
    quote = np.flatnonzero(points == ord("'"))
    if len(quote):
        a, b = after[quote], after2[quote]
        cls[quote[np.isin(a, [ord(c) for c in SHORT_TAILS])]] = QUOTE2
        for tail in LONG_TAILS:
            cls[quote[(a == ord(tail[0])) & (b == ord(tail[1]))]] = QUOTE3
    acts, table, apply, flags = _automaton()
    # Blocks side by side: the running composite of every block, column by column ...
    width = 64
    n, rows = len(cls), -(-len(cls) // width)
    grid = np.full(rows * width, BREAK, np.uint8)
    grid[:n] = cls
    grid = grid.reshape(rows, width).T.copy()
    whole = acts[grid[0]]
    for col in grid[1:]:
        whole = table[whole, acts[col]]
    # ... then an associative scan over the blocks' composites (doubling distances) ...
    scan, d = whole, 1
    while d < rows:
        scan = np.concatenate([scan[:d], table[scan[:-d], scan[d:]]])
        d *= 2
    state = np.concatenate([[FRESH], apply[scan[:-1], FRESH]]).astype(np.uint8)
    # ... and one more pass with every block's first state known.
    step = apply[acts]  # class, state -> next state
    begins = np.empty((width, rows), bool)
    for j in range(width):
        begins[j] = flags[state, grid[j]]
        state = step[grid[j], state]
    return begins.T.reshape(-1)[:n]


@lru_cache(2)
def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a token's bytes in base64, a blank, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def _token_bytes(path: str) -> list[bytes]:
    ranks = load_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


class Merger:
    """Merges many short slices side by side: in every round each slice merges its pair of lowest
    rank, the leftmost of equals. Pair ranks come from an open-addressed table of numpy arrays."""

    WIDTHS = (8, 16, 32, 64)  # slices are padded to the next of these
    NONE = np.int32(1 << 30)

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items()
                 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.bits = max(10, (len(pairs) * 4).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.values = np.full(len(self.keys), self.NONE, np.int32)
        keys, values = (np.array(x, dtype=np.int64) for x in (zip(*pairs) if pairs else ((), ())))
        at, self.probes = self._slot(keys), 0
        while len(keys):  # all keys try their next place together; one wins each place
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], at[~won] + 1
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b make; NONE if there is none or either is negative."""
        keys = a.astype(np.int64) << 32 | b
        keys[(a < 0) | (b < 0)] = -2
        at = self._slot(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], self.NONE)
        todo = np.flatnonzero((there != keys) & (there != -1))
        while len(todo):
            at[todo] += 1
            there = self.keys[at[todo]]
            same = there == keys[todo]
            out[todo[same]] = self.values[at[todo[same]]]
            todo = todo[~same & (there != -1)]
        return out

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each slice, as the bytes of 32-bit numbers."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.ranks.get(p)) is not None:
                out[i] = np.int32(r).tobytes()
            elif len(p) > self.WIDTHS[-1]:
                out[i] = np.array(merge_long(p, self.ranks), np.int32).tobytes()
            else:
                by_width.setdefault(next(w for w in self.WIDTHS if len(p) <= w), []).append(i)
        for width, places in by_width.items():
            for i, ids in zip(places, self._side_by_side([pieces[i] for i in places], width)):
                out[i] = ids
        return out

    def _side_by_side(self, pieces: list[bytes], width: int) -> list[bytes]:
        cols = np.arange(width)
        size = np.array([len(p) for p in pieces])
        data = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(-1, width)
        ids = np.full((len(pieces), width + 1), -1, np.int32)  # one column more, to shift from
        ids[:, :width] = np.where(cols < size[:, None], self.single[data], np.int32(-1))
        order = np.full(ids.shape, self.NONE, np.int32)
        order[:, :-1] = self.pair(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width)
        # Merging j with the next live place takes that place away; places know their neighbours.
        after = np.tile(np.arange(1, width + 2, dtype=np.int8), (len(pieces), 1))
        before = np.tile(np.arange(-1, width, dtype=np.int8), (len(pieces), 1))
        rows = np.arange(len(pieces))
        while len(rows):
            j = order[rows].argmin(1) if len(rows) < len(order) else order.argmin(1)
            rank = order[rows, j]
            if not (more := rank != self.NONE).all():
                rows, j, rank = rows[more], j[more], rank[more]
            k = after[rows, j]
            nxt = after[rows, k]
            ids[rows, j], ids[rows, k] = rank, -1
            after[rows, j], before[rows, np.minimum(nxt, width)] = nxt, j
            order[rows, k] = self.NONE
            order[rows, j] = self.pair(rank, ids[rows, np.minimum(nxt, width)])
            left = np.flatnonzero(j > 0)
            lr, lj = rows[left], before[rows[left], j[left]]
            order[lr, lj] = self.pair(ids[lr, lj], rank[left])
        kept = ids >= 0
        raw, cut = ids[kept].tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        return [raw[a:b] for a, b in zip([0, *cut], cut)]


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long slice: a heap of (rank, position) over a doubly linked list, n log n."""
    from heapq import heapify, heappop, heappush

    n = len(piece)
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    live = [True] * n

    def pair(i: int):
        j = nxt[i]
        return ranks.get(piece[i:end[j]]) if j < n else None

    heap = [(r, i, end[nxt[i]]) for i in range(n - 1) if (r := pair(i)) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        if not live[i] or nxt[i] >= n or end[nxt[i]] != stop:
            continue  # one of the two has been merged since
        j = nxt[i]
        live[j], end[i], nxt[i] = False, stop, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        for k in (prev[i], i):
            if k >= 0 and (r := pair(k)) is not None:
                heappush(heap, (r, k, end[nxt[k]]))
    return [ranks[piece[i:end[i]]] for i in range(n) if live[i]]


class Encoder:
    """Encodes batches of texts; remembers the ids of slices within bounds.

    Two generations of slices are kept: a full one becomes the old one, and what is used again moves
    to the young one.
    """

    def __init__(self, path: str):
        self.ranks, self.tokens = load_ranks(path), _token_bytes(path)
        self.lengths = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.merger = Merger(self.ranks)
        self.young: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}

    def _look_up(self, pieces: list[bytes]) -> list[bytes]:
        got = list(map(self.young.get, pieces))
        if missing := [i for i, ids in enumerate(got) if ids is None]:
            found = {p: self.old.get(p) for p in map(pieces.__getitem__, missing)}
            new = [p for p, ids in found.items() if ids is None]
            found |= zip(new, self.merger.many(new))
            if len(self.young) >= CACHE_ENTRIES:
                self.old, self.young = self.young, {b"": b""}
            self.young |= {p: ids for p, ids in found.items() if len(p) <= CACHE_SLICE}
            for i in missing:
                got[i] = found[pieces[i]]
        return got

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        sep = np.array([END], dtype=np.uint32)
        parts = [p for t in texts for p in (np.frombuffer(t.encode("utf-32-le"), np.uint32), sep)]
        if not parts:
            return []
        points = np.concatenate(parts)
        starts = np.flatnonzero(boundaries(points))
        # Byte positions: every text's UTF-8 is laid end to end, END takes no bytes.
        size = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        size[points == END] = 0
        data = "".join(texts).encode()
        cut = (np.cumsum(size, dtype=np.int64) - size)[starts].tolist()
        got = self._look_up([data[a:b] for a, b in zip(cut, [*cut[1:], len(data)])])
        ends = np.flatnonzero(points[starts] == END).tolist()
        return [np.frombuffer(b"".join(got[a:b]), np.int32) for a, b in zip([0, *ends], ends)]

    def batches(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """Ranges of texts of about BLOCK_CHARS code points."""
        begin, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > BLOCK_CHARS:
                yield begin, i
                begin, size = i, 0
            size += len(t) + 1
        if begin < len(texts):
            yield begin, len(texts)


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """The worker's encoder: what one task has merged, the next need not."""
    return Encoder(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     offsets: bool = True) -> DataFrame:
    """One row per document: ``id_col``, ``ids``, ``starts`` (each token's first byte in the text's UTF-8).

    Null and empty texts give empty arrays; ``offsets=False`` leaves ``starts`` null. Rows that repeat
    an id or a text are rows of their own; extra columns are ignored. Nothing is shuffled."""
    prepare(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in enc.batches(texts):
                ids = enc.encode(texts[a:b])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids)
                starts = pa.nulls(b - a, pa.list_(pa.int64()))
                if offsets:
                    size = enc.lengths[flat]
                    at = np.cumsum(size) - size
                    first = np.repeat(at[np.minimum(ends[:-1], max(0, len(at) - 1))] if len(at) else ends[:-1], np.diff(ends))
                    starts = pa.ListArray.from_arrays(pa.array(ends), pa.array(at - first))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), starts],
                    names=[id_col, "ids", "starts"])

    own = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = own.schema[0].dataType.simpleString()
    return own.mapInArrow(encode, f"`{id_col}` {kind}, ids array<int>, starts array<bigint>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per encoded document: ``id_col``, ``ids``, ``decoded`` (binary; null for null ids).

    An id outside the rank file raises."""
    prepare(encoded.sparkSession)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _encoder(path).tokens
        for batch in batches:
            ids = batch.column(1)
            rows = [None if x is None else b"".join(map(tokens.__getitem__, x.values.to_numpy().tolist()))
                    for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(rows, pa.binary())],
                                             names=[id_col, "ids", "decoded"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, "ids").mapInArrow(decode, f"`{id_col}` {kind}, ids array<int>, decoded binary")
