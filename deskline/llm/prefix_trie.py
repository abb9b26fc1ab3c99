"""Prefix trie of conversations by vertical bitmaps (operator 12).

A node is a distinct sequence of first turns; its members are the conversations that start with it.

1. Every conversation's turns get a place (``dense_number``) and a fingerprint: 128 bits of the SHA-256 of
   role and text. Texts travel no further.
2. Conversations in the order of their ids are cut into shards of ``SHARD``; places into blocks of
   ``BLOCK``, so a task's piece is bounded however long one conversation is. A conversation longer than a
   block enters its next block at the node that its turns so far end at.
3. Inside a piece, an index maps (place, turn) to the bitset of the conversations with that turn there. Going
   depth first, a node's bitset is intersected with the postings of its members' next turns: each
   non-empty intersection is a child, its population count the number of members; a bitset of the
   conversations that end at a place gives the node's end list.
4. Nodes of all shards meet by the digest of their prefix: one narrow row a node and shard, summed before
   the shuffle, so a node that all conversations share costs a row a shard.
5. Sums over subtrees double their reach: from descendants nearer than 2^k to those nearer than 2^(k+1)
   by one grouped sum over the ancestors at distance 2^k. Rounds grow with the log of the depth.

End lists are hashed as a stream, shard after shard; SHA-256 is a chain, so one node's list passes one
task, but never as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.llm.common import prepare, stored
from deskline.operators.ranking import dense_number

SHARD = 1024  # conversations of a bitset
BLOCK = 256  # places of a piece
HEX = 32  # hex digits of fingerprints and node digests: 128 bits of a SHA-256
ROOT = "0" * HEX
_NODE = "node string, parent string, depth long, conv long, n long, size long, shard long, ends string"


def turn_fingerprint(role: Column, text: Column) -> Column:
    """Fingerprint of a turn; null role and text count as empty."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.sha2(told.cast("binary"), 256), 1, HEX)


def placed_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """``conv`` (long), ``pos`` (from 0), ``fp`` and ``size`` (code points of the text) of every turn.

    Turns ascend, null ones first; rows that repeat a turn number are turns of their own, in the order of
    their fingerprints. Rows without a conversation id belong to none and are left out."""
    own = turns.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        turn_fingerprint(F.col(role_col), F.col(text_col)).alias("fp"),
        F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("size"))
    return dense_number(own.filter("conv IS NOT NULL"), ["conv"], ["turn", "fp"], "pos").drop("turn")


def _digest(state: str, chain: str) -> str:
    return hashlib.sha256((state + chain).encode()).hexdigest()[:HEX]


def _entries(turns: DataFrame, members: DataFrame) -> DataFrame:
    """Where conversations longer than a block enter their later blocks: ``conv``, ``block``, ``state``
    (the digest of the node they stand at). Block 0 is entered at the root by all."""
    later = stored(turns.filter(F.col("pos") >= BLOCK).select("conv").distinct(), "trie_long")
    whole = turns.join(later, "conv", "left_semi").withColumn("block", F.expr(f"pos div {BLOCK}"))
    # at most BLOCK turns of a full block, so this list is bounded
    full = whole.groupBy("conv", "block").agg(F.sort_array(F.collect_list(F.struct("pos", "fp"))).alias("row"))
    full = full.filter(F.size("row") == BLOCK).select("conv", "block", F.sha2(
        F.array_join(F.transform("row", lambda x: x["fp"]), "").cast("binary"), 256).alias("chain"))

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        states, state = [], ROOT
        for chain in group["chain"]:
            state = _digest(state, chain)
            states.append(state)
        return pd.DataFrame({"conv": group["conv"], "block": group["block"] + 1, "state": states})

    return stored(full.groupBy("conv").applyInPandas(walk, "conv long, block long, state string"), "trie_entries")


def _walk(piece: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one piece (a shard's conversations between two places): see ``_NODE``.

    Rows: ``conv``, ``pos`` (null: no turn here), ``fp``, ``size``, ``length`` (of the conversation),
    ``state`` (digest of the node where it enters), ``block``, ``shard``. A piece tells of the nodes below
    its entries; the piece of block 0 of the root too."""
    block, shard = int(piece["block"].iloc[0]), int(piece["shard"].iloc[0])
    first = block * BLOCK
    heads = piece.drop_duplicates("conv").sort_values("conv")
    convs = heads["conv"].tolist()
    bit = {c: 1 << i for i, c in enumerate(convs)}
    index: dict[tuple[int, str], int] = {}  # (place, turn) -> bitset of conversations
    at: dict[tuple[int, int], tuple[str, int]] = {}  # (conversation's number, place) -> turn
    own = piece[piece["pos"].notna()]
    for c, p, fp, size in zip(own["conv"], own["pos"].astype("int64"), own["fp"], own["size"]):
        index[p, fp] = index.get((p, fp), 0) | bit[c]
        at[bit[c].bit_length() - 1, p] = (fp, size)
    ending: dict[int, int] = {}  # depth -> bitset of the conversations that have so many turns
    entry: dict[str, int] = {}  # digest -> bitset of the conversations that enter there
    for c, length, state in zip(heads["conv"], heads["length"], heads["state"]):
        ending[length] = ending.get(length, 0) | bit[c]
        entry[state] = entry.get(state, 0) | bit[c]

    def lowest(bits: int) -> int:
        return (bits & -bits).bit_length() - 1

    def members(bits: int) -> str:
        out = []
        while bits:
            i = lowest(bits)
            out.append(str(convs[i]))
            bits &= bits - 1
        return ",".join(out)

    rows = []
    for state, entering in entry.items():
        if block == 0:
            rows.append((ROOT, None, 0, convs[lowest(entering)], entering.bit_count(), 0, shard, members(entering & ending.get(0, 0))))
        stack = [(state, first, entering, hashlib.sha256())]
        while stack:
            parent, depth, bits, chain = stack.pop()
            rest = bits & ~ending.get(depth, 0)
            if depth == first + BLOCK:
                continue  # the rest goes on in the next block
            while rest:
                fp, size = at[lowest(rest), depth]
                child = rest & index[depth, fp]
                rest &= ~child
                so_far = chain.copy()
                so_far.update(fp.encode())
                node = _digest(state, so_far.hexdigest())
                rows.append((node, parent, depth + 1, convs[lowest(child)], child.bit_count(), size, shard,
                             members(child & ending.get(depth + 1, 0))))
                stack.append((node, depth + 1, child, so_far))
    return pd.DataFrame(rows, columns=["node", "parent", "depth", "conv", "n", "size", "shard", "ends"])


def _ends_hash(parts: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256`` of the nodes where conversations end; a node's parts pass as a stream."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, h = None, None
        for batch in batches:
            nodes, out = [], []
            for node, ends in zip(batch["node"], batch["ends"]):
                if node != now:
                    if now is not None:
                        nodes.append(now)
                        out.append(h.hexdigest())
                    now, h = node, hashlib.sha256(ends.encode())
                else:
                    h.update(b"," + ends.encode())
            yield pd.DataFrame({"node": nodes, "ends_sha256": out}, dtype=object)
        if now is not None:
            yield pd.DataFrame({"node": [now], "ends_sha256": [h.hexdigest()]})

    dealt = parts.repartition("node").sortWithinPartitions("node", "shard")
    return dealt.mapInPandas(stream, "node string, ends_sha256 string")


def _subtree_sums(nodes: DataFrame, cols: list[str]) -> DataFrame:
    """``node`` and the sums of ``cols`` over its subtree, itself included.

    ``reach`` holds the sums over descendants nearer than 2^k, ``far`` the ancestor at distance 2^k."""
    depth = nodes.agg(F.max("depth")).first()[0] or 0
    reach = nodes.select("node", *cols)
    far = nodes.filter("depth > 0").select("node", "depth", F.col("parent").alias("far"))
    step = 1
    while step <= depth:
        up = far.join(reach, "node").groupBy(F.col("far").alias("top")).agg(*[F.sum(c).alias(f"_{c}") for c in cols])
        grown = reach.join(up, F.col("node") == F.col("top"), "left").select(
            "node", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in cols])
        reach = stored(grown, "trie_reach")
        nearer = far.select(F.col("node").alias("mid"), F.col("far").alias("next"))
        far = stored(far.filter(F.col("depth") >= 2 * step).join(nearer, F.col("far") == F.col("mid"))
                     .select("node", "depth", F.col("next").alias("far")), "trie_far")
        step *= 2
    return reach


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the trie of all conversations in ``members`` (``conv``, long, each once).

    ``turns``: ``conv``, ``pos`` (from 0, without gaps), ``fp`` (equal for equal turns only) and ``size``.
    A conversation without turns is a member of the root and ends there. One row a node: ``node`` and
    ``parent`` (digests of the prefixes; the root's parent is null), ``depth``, ``conv_id`` (smallest
    member), ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of the subtree),
    ``saved_tokens`` ((n_convs - 1) x size, summed over the subtree), ``ends_sha256``. No conversations: no
    rows, not even a root."""
    prepare(turns.sparkSession)
    numbered = dense_number(members.select("conv"), [], ["conv"], "i")
    ids = numbered.select(F.col("conv").alias("c"), F.expr(f"i div {SHARD}").alias("shard"))
    ids = stored(ids, "trie_ids")
    lengths = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("length"))
    ids = stored(ids.join(lengths, F.col("c") == F.col("conv"), "left").select(
        "c", "shard", F.coalesce("length", F.lit(0)).alias("length")), "trie_ids")
    entries = _entries(turns, ids).select(F.col("conv").alias("ec"), F.col("block").alias("eb"), "state")
    rows = turns.join(ids, F.col("conv") == F.col("c")).select(
        "conv", "pos", "fp", "size", "length", F.expr(f"pos div {BLOCK}").alias("block"), "shard")
    bare = ids.filter("length = 0").select(
        F.col("c").alias("conv"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("string").alias("fp"),
        F.lit(0).cast("long").alias("size"), "length", F.lit(0).cast("long").alias("block"), "shard")
    later = rows.filter("block > 0").join(entries, (F.col("conv") == F.col("ec")) & (F.col("block") == F.col("eb"))).drop("ec", "eb")
    at_root = rows.filter("block = 0").unionByName(bare).withColumn("state", F.lit(ROOT))
    pieces = at_root.unionByName(later).groupBy("shard", "block")
    found = stored(pieces.applyInPandas(_walk, _NODE), "trie_nodes")

    nodes = found.groupBy("node").agg(F.first("parent", True).alias("parent"), F.first("depth").alias("depth"),
                                      F.min("conv").alias("conv_id"), F.sum("n").alias("n_convs"),
                                      F.first("size").alias("size"))
    nodes = stored(nodes, "trie_merged")
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("p")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, F.col("node") == F.col("p"), "left").drop("p").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0)))
    ends = _ends_hash(found.filter("ends <> ''").select("node", "shard", "ends"))
    nodes = nodes.join(ends.withColumnRenamed("node", "e"), F.col("node") == F.col("e"), "left").drop("e")
    nodes = stored(nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))), "trie_full")
    sums = _subtree_sums(nodes.select("node", "parent", "depth", F.when(F.col("n_children") == 0, 1).otherwise(0)
                                      .cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")),
                         ["n_leaves", "saved_tokens"])
    above = nodes.filter("n_children > 0").select(F.col("node").alias("p"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(above, F.col("parent") == F.col("p"), "left").join(sums, "node")
            .select("node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                    "saved_tokens", "ends_sha256"))


def graft_heads(turns: DataFrame, base: Column, keep: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations whose beginnings are replaced: ``(turns, members)`` for ``prefix_trie``.

    ``turns`` as of ``placed_turns``; ``base`` and ``keep`` are expressions over ``conv``. Conversation c gets the
    first ``keep`` (``most`` at most) turns of conversation ``base`` (all if there are fewer, none if
    there is no such conversation), then its own turns after its first ``keep``. Conversations that lose all
    turns stay members."""
    turns = stored(turns, "trie_turns")
    members = stored(turns.filter("pos = 0").select("conv"), "trie_members")
    plan = members.select("conv", base.alias("base"), keep.cast("long").alias("keep"))
    heads = turns.filter(F.col("pos") < most).select(F.col("conv").alias("hc"), F.col("pos").alias("hp"), "fp", "size")
    heads = stored(heads.join(plan.select(F.col("base").alias("hb")).distinct(), F.col("hc") == F.col("hb"), "left_semi"), "trie_heads")
    taken = plan.join(heads, (F.col("base") == F.col("hc")) & (F.col("hp") < F.col("keep"))).select(
        "conv", F.col("hp").alias("pos"), "fp", "size")
    counts = heads.groupBy(F.col("hc").alias("bc")).agg(F.count(F.lit(1)).alias("has"))
    own = turns.withColumn("base", base).withColumn("keep", keep.cast("long")).filter("pos >= keep")
    own = own.join(counts, F.col("base") == F.col("bc"), "left").select(
        "conv", (F.col("pos") - F.col("keep") + F.least("keep", F.coalesce("has", F.lit(0)))).alias("pos"), "fp", "size")
    return stored(taken.unionByName(own), "trie_rebuilt"), members
