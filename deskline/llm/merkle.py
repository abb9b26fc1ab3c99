"""Merkle manifest of a dataset by slot pivots (operator 11), DataFrame functions only.

Rows become leaves; the leaves of a group, in the order of their ids, are hashed in runs of ``fanout``
up to the group's root, and the groups' roots, in the order of the groups, up to the root of all.

* Slot pivot: a parent's children are spread into ``fanout`` columns by conditional aggregates (a child's
  slot is its place modulo ``fanout``). The columns one after another are what the parent hashes.
* Proofs: leaving a child's own slot column out of its parent's row gives its siblings, those left and
  those right of it. Going down from the top, each pivot row meets its own parent's proof once and hands
  it on with the siblings added, so a level's join has a row for a parent, not one for every leaf.

Places come from ``dense_number``: ranges of the sort order and offsets, so a group that holds a third
of all rows is spread like all others. A level has an eighth of the rows of the one below.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.llm.common import stored
from deskline.operators.ranking import dense_number

FANOUT = 8


def field(c: Column) -> Column:
    """A value with its length in UTF-8 bytes, so that joined fields cannot be read in two ways; null is ``-``."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 (lower-case hex) of a row's fields one after another."""
    return F.sha2(F.concat(*[field(c) for c in fields]).cast("binary"), 256)


def _joined(cells: Sequence[Column]) -> Column:
    return F.concat_ws("", *cells) if cells else F.lit("")


def _digest(cell: Column) -> Column:
    return cell["leaf"]


def _climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Pivot rows of every level, the lowest first, and each group's root (``g``, ``n``, ``digest``).

    ``nodes``: group ``g``, place ``at``, rows of the group ``n`` and a struct ``cell`` with the digest
    ``leaf``. Groups leave the climb at the level where one node remains."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, roots, width = [], [], 1
    while True:
        roots.append(nodes.filter(F.col("n").between(width // fanout + 1, width))
                     .select("g", "n", F.col("cell.leaf").alias("digest")))
        if width >= most:
            break
        slots = [F.max(F.when(F.col("at") % fanout == i, F.col("cell"))).alias(f"s{i}") for i in range(fanout)]
        pivot = (nodes.filter(F.col("n") > width).groupBy("g", F.expr(f"at div {fanout}").alias("up"))
                 .agg(F.max("n").alias("n"), *slots))
        levels.append(stored(pivot, "merkle_level"))
        parent = F.sha2(_joined([_digest(F.col(f"s{i}")) for i in range(fanout)]).cast("binary"), 256)
        nodes = levels[-1].select("g", F.col("up").alias("at"), "n", F.struct(parent.alias("leaf")).alias("cell"))
        width *= fanout
    return levels, stored(reduce(DataFrame.unionByName, roots), "merkle_roots")


def _descend(levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The ``cell`` of every leaf of ``levels`` with its group's columns of ``tops`` and its whole ``path``:
    structs (left, right) of the siblings' digests at every level, the lowest first.

    ``tops``: ``g``, ``n``, the path above the group's root, and what else its leaves are to carry. Groups
    of one leaf are in no level; they are the caller's."""
    carry = [c for c in tops.columns if c not in ("g", "n", "path")]
    above = None
    for k in range(len(levels) - 1, -1, -1):
        here = tops.filter(F.col("n").between(fanout ** k + 1, fanout ** (k + 1)))
        here = here.select(F.col("g").alias("pg"), F.lit(0).cast("long").alias("pat"), "path", *carry)
        above = here if above is None else here.unionByName(
            above.select(F.col("g").alias("pg"), F.col("at").alias("pat"), "path", *carry))
        slots = [F.col(f"s{i}") for i in range(fanout)]
        children = F.array(*[F.struct(
            F.lit(i).alias("slot"), slots[i].alias("cell"),
            F.struct(_joined([_digest(s) for s in slots[:i]]).alias("left"),
                     _joined([_digest(s) for s in slots[i + 1:]]).alias("right")).alias("run")) for i in range(fanout)])
        rows = levels[k].join(above, (F.col("g") == F.col("pg")) & (F.col("up") == F.col("pat")))
        rows = rows.select("g", "up", "path", *carry, F.explode(children).alias("child")).filter("child.cell IS NOT NULL")
        above = rows.select("g", (F.col("up") * fanout + F.col("child.slot")).alias("at"), F.col("child.cell").alias("cell"),
                            F.concat(F.array("child.run"), "path").alias("path"), *carry)
    return above


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda acc, run: F.sha2(
        F.concat(run["left"], acc, run["right"]).cast("binary"), 256))


def path_text(path: Column) -> Column:
    """The siblings' digests one after another, level by level, left to right."""
    return F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), "")


def manifest(rows: DataFrame, id_col: str, group_col: str, leaf: Column, claimed: Column | None = None,
             fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``rows``: ``id_col``, ``leaf``, ``subroot`` (its group's root), ``root``, ``path``
    (its proof: structs left, right a level), ``folded_root`` (from ``claimed``, else ``leaf``, and the
    path) and ``verified`` (whether that is the root).

    ``leaf`` is the digest of a row (``leaf_digest``), ``claimed`` one to be checked in its place (null:
    the leaf itself). Leaves of a group ascend by id, null ids first, rows of one id by their leaf (fully
    equal rows change places without effect). Null groups are a group, before all others; groups ascend
    by value (text bytewise). A group of one row has its leaf as root, a table of one group that group's
    root; proofs of runs of one node are empty. Other columns are left out, whatever their names; an
    empty table gives no rows.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    claim = F.lit(None).cast("string") if claimed is None else claimed
    leaves = rows.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf.alias("leaf"), claim.alias("claim"))
    leaves = dense_number(leaves, ["grp"], ["id", "leaf"], "at", size="n")
    groups = leaves.filter("at = 0").select("grp", "n")
    groups = stored(dense_number(groups, [], ["grp"], "g", size="groups"), "merkle_groups")
    named = groups.select(F.col("grp").alias("name"), "g")
    leaves = leaves.join(named, F.col("grp").eqNullSafe(F.col("name"))).select(
        "g", "at", "n", F.struct("leaf", "claim", "id").alias("cell"))
    leaves = stored(leaves, "merkle_leaves")

    levels, subroots = _climb(leaves, fanout)
    top = subroots.join(groups.select(F.col("g").alias("h"), "groups"), F.col("g") == F.col("h")).select(
        F.lit(0).cast("long").alias("g"), F.col("g").alias("at"), F.col("groups").alias("n"),
        F.struct(F.col("digest").alias("leaf"), "g", F.col("n").alias("rows")).alias("cell"))
    top = stored(top, "merkle_top")
    top_levels, root = _climb(top, fanout)
    none = F.array().cast("array<struct<left:string,right:string>>")
    start = root.select("g", "n", none.alias("path"), F.col("digest").alias("root"))
    lone = top.filter("n = 1").join(start.select(F.col("g").alias("h"), "path", "root"), F.col("g") == F.col("h"))
    tops = lone.select("cell", "path", "root")
    if top_levels:
        tops = tops.unionByName(_descend(top_levels, start, fanout).select("cell", "path", "root"))
    tops = stored(tops.select(F.col("cell.g").alias("g"), F.col("cell.rows").alias("n"),
                              F.col("cell.leaf").alias("subroot"), "root", "path"), "merkle_tops")

    alone = leaves.filter("n = 1").select("g", "cell")
    out = alone.join(tops.withColumnRenamed("g", "h"), F.col("g") == F.col("h")).select("cell", "subroot", "root", "path")
    if levels:
        out = out.unionByName(_descend(levels, tops, fanout).select("cell", "subroot", "root", "path"))
    folded = fold(F.coalesce("cell.claim", "cell.leaf"), F.col("path"))
    out = out.select(F.col("cell.id").alias(id_col), F.col("cell.leaf").alias("leaf"), "subroot", "root", "path",
                     folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
