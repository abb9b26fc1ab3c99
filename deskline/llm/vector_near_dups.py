"""Exact cosine links between embeddings by PCA-ordered tiled comparison (operator 6).

Unit vectors are turned into the principal axes, largest variance first. Two unit vectors of cosine
c or more differ by at most sqrt(2 - 2c) in every coordinate, so only neighbouring cells of that
width along the first axis are compared. Cells are cut into tiles of bounded size and every pair of
tiles that may hold a link is one small task group:

* leading coordinates are accumulated block by block,
* what the rest can add is bounded by the product of the suffix norms,
* the comparison stops when no pair of the tile can reach the threshold any more,
* pairs that survive are decided on the original vectors in double precision.

A tile pair returns link counts and a spanning forest of its links, never all its links, so dense
groups stay linear in what they send on. Equal vectors are compared once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.llm.common import prepare, stored
from deskline.llm.components import components, smallest_reachable

TILE = 1024  # vectors of a tile
STEPS = (4, 8, 16, 32, 64, 128, 256, 512)  # leading dimensions after which pairs are given up
SLACK = 1e-9  # what rounding may take from a bound


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one (scaled first, so that no square over- or underflows)."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """Axes by dimension number, largest variance first, from all unit vectors' second moments.

    Every task sends dim x dim sums at most; Spark adds them up and dim x dim numbers reach the
    driver. Any orthogonal axes give right results: these only make pairs fail early. They are found
    for the most common dimension number; other vectors keep their own axes.
    """
    sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    if not sizes:
        return {}
    dim = sizes[0]["dim"]

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if len(batch):
                x = _unit(_matrix(batch["vector"]))
                total += x.T @ x
        yield pd.DataFrame({"at": np.arange(dim * dim), "v": total.reshape(-1)})

    sums = (classes.filter(F.col("dim") == dim).select("vector").mapInPandas(moments, "at int, v double")
            .groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at"))
    _, axes = np.linalg.eigh(sums["v"].to_numpy().reshape(dim, dim))
    return {dim: np.ascontiguousarray(axes[:, ::-1])}


def usable(vector: str) -> Column:
    """True for a vector that can link: not null or empty, all components finite, not all zero."""
    return F.coalesce(F.expr(
        f"size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
        f" AND exists({vector}, x -> x <> 0)"), F.lit(False))


def compare_tiles(a: np.ndarray, b: np.ndarray, threshold: float, axes: np.ndarray | None,
                  same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of all pairs of unit vectors with cosine >= threshold; ``same``: i < j only."""
    ra, rb = (a, b) if axes is None else (a @ axes, b @ axes)
    dim = a.shape[1]
    suffix = [np.sqrt(np.maximum(0.0, 1.0 - np.cumsum(r * r, axis=1))) for r in (ra, rb)]
    part, begin, i, j = np.zeros((len(a), len(b))), 0, None, None
    for end in [s for s in STEPS if s < dim]:
        if i is None:
            part += ra[:, begin:end] @ rb[:, begin:end].T
            open_ = part + np.outer(suffix[0][:, end - 1], suffix[1][:, end - 1]) >= threshold - SLACK
            if same:
                open_ &= np.tri(len(a), dtype=bool).T & ~np.eye(len(a), dtype=bool)
            n = np.count_nonzero(open_)
            if n <= open_.size // 8:  # few are left: go on pair by pair
                i, j = np.nonzero(open_)
                held = part[i, j]
        else:
            held = held + (ra[i, begin:end] * rb[j, begin:end]).sum(axis=1)
            keep = held + suffix[0][i, end - 1] * suffix[1][j, end - 1] >= threshold - SLACK
            i, j, held = i[keep], j[keep], held[keep]
        if i is not None and not len(i):
            return i, j
        begin = end
    if i is None:
        part += ra[:, begin:] @ rb[:, begin:].T
        open_ = part >= threshold - SLACK
        if same:
            open_ &= np.tri(len(a), dtype=bool).T & ~np.eye(len(a), dtype=bool)
        i, j = np.nonzero(open_)
    exact = np.empty(len(i))
    for s in range(0, len(i), 1 << 16):
        exact[s:s + (1 << 16)] = np.einsum("ij,ij->i", a[i[s:s + (1 << 16)]], b[j[s:s + (1 << 16)]])
    return i[exact >= threshold], j[exact >= threshold]


def link_vectors(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id",
                 vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, ``n_links``, ``component_id`` (smallest id reachable), ``kept``.

    Vectors are compared if their labels are equal and not null and their dimensions agree; a link is
    a cosine of ``threshold`` (above 0) or more. Vectors that are null, empty, zero, or hold null, NaN
    or infinite components link with nothing. Rows with equal label and vector link with one another;
    rows that repeat an id are vectors of their own. Null ids take part but name no component.
    """
    prepare(vectors.sparkSession)
    spark = vectors.sparkSession
    own = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"),
                         F.col(vector_col).alias("vector"), usable(f"`{vector_col}`").alias("ok"))
    own = own.withColumn("ok", F.col("ok") & F.col("label").isNotNull())
    # Equal vectors are one class; 256 bits of a digest stand for (label, vector).
    key = F.when(F.col("ok"), F.sha2(F.concat_ws("|", "label", F.col("vector").cast("array<double>").cast("string"))
                                     .cast("binary"), 256))
    keyed = stored(own.select("id", key.alias("key")), "vector_keys")
    counts = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.count(F.lit(1)).alias("weight"))
    classes = own.filter("ok").select(key.alias("key"), "label", F.col("vector").cast("array<double>").alias("vector"))
    classes = classes.groupBy("key").agg(F.any_value("label").alias("label"), F.any_value("vector").alias("vector"))
    classes = stored(classes.join(counts, "key").withColumn("dim", F.size("vector")), "vector_classes")
    axes = spark.sparkContext.broadcast(principal_axes(classes))

    width = math.sqrt(2 - 2 * threshold) * (1 + 1e-9) + 1e-9

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first = np.zeros(len(batch))
            for dim, rows in batch.groupby("dim").indices.items():
                x = _unit(_matrix(batch["vector"].iloc[rows]))
                first[rows] = x @ axes.value[dim][:, 0] if dim in axes.value else x[:, 0]
            yield batch.assign(cell=np.floor(first / width).astype(np.int64))

    placed = classes.mapInPandas(place, "key string, label string, vector array<double>, weight long, dim int, cell long")
    placed = stored(placed, "vector_cells")
    cells = placed.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("tiles", F.ceil(F.col("n") / TILE).cast("long"))
    tiled = placed.join(cells.drop("n"), ["label", "dim", "cell"]).withColumn(
        "tile", F.pmod(F.xxhash64("key"), F.col("tiles")))
    # A tile goes to every pair it is in: with the later tiles of its cell and all tiles of the next cell.
    nxt = cells.select("label", "dim", (F.col("cell") - 1).alias("cell"), F.col("tiles").alias("after"))
    prev = cells.select("label", "dim", (F.col("cell") + 1).alias("cell"), F.col("tiles").alias("before"))
    tiled = tiled.join(nxt, ["label", "dim", "cell"], "left").join(prev, ["label", "dim", "cell"], "left")
    as_left = ("concat(transform(sequence(tile, tiles - 1), t -> struct(cell AS c1, tile AS t1, cell AS c2, t AS t2, 0 AS side)),"
               " if(after > 0, transform(sequence(0L, after - 1), t -> struct(cell AS c1, tile AS t1, cell + 1 AS c2, t AS t2, 0 AS side)), array()))")
    as_right = ("concat(if(tile > 0, transform(sequence(0L, tile - 1), t -> struct(cell AS c1, t AS t1, cell AS c2, tile AS t2, 1 AS side)), array()),"
                " if(before > 0, transform(sequence(0L, before - 1), t -> struct(cell - 1 AS c1, t AS t1, cell AS c2, tile AS t2, 1 AS side)), array()))")
    dealt = tiled.select("key", "label", "dim", "vector", "weight", F.expr(f"explode(concat({as_left}, {as_right}))").alias("p"))
    dealt = dealt.select("key", "label", "dim", "vector", "weight", "p.*")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        one = group.iloc[0]
        same = one["c1"] == one["c2"] and one["t1"] == one["t2"]
        left = group[group["side"] == 0].sort_values("key")
        right = left if same else group[group["side"] == 1].sort_values("key")
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "links": [], "root": []})
        a = _unit(_matrix(left["vector"]))
        b = a if same else _unit(_matrix(right["vector"]))
        i, j = compare_tiles(a, b, threshold, axes.value.get(int(one["dim"])), same)
        wa, wb = left["weight"].to_numpy(), right["weight"].to_numpy()
        if same:
            links = np.bincount(i, wa[j], len(a)) + np.bincount(j, wa[i], len(a))
            keys, root = left["key"].to_numpy(), smallest_reachable(len(a), i, j)
        else:
            links = np.concatenate([np.bincount(i, wb[j], len(a)), np.bincount(j, wa[i], len(b))])
            keys = np.concatenate([left["key"].to_numpy(), right["key"].to_numpy()])
            root = smallest_reachable(len(keys), i, j + len(a))
        some = links > 0
        return pd.DataFrame({"key": keys[some], "links": links[some].astype(np.int64), "root": keys[root[some]]})

    found = stored(dealt.groupBy("label", "dim", "c1", "t1", "c2", "t2").applyInPandas(
        compare, "key string, links long, root string"), "vector_links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(found.filter("key <> root"), "key", "root").withColumnRenamed("node", "key")
    per_class = counts.join(links, "key", "left").join(groups, "key", "left").select(
        F.col("key").alias("k"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "key").alias("g"))
    rows = keyed.join(per_class, F.col("key") == F.col("k"), "left").select("id", "n_links", "g")
    least = rows.filter("g IS NOT NULL").groupBy("g").agg(F.min("id").alias("least")).withColumnRenamed("g", "h")
    out = rows.join(least, F.col("g") == F.col("h"), "left")
    component = F.coalesce("least", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
