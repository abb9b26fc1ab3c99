"""Keyed upsert (MERGE) as a DataFrame operator.

``upsert`` returns the new snapshot of ``target`` after applying ``source``:

* the source is reduced to one row per key, the *last* in ``order_by`` (``dedupe_last``: a top-1
  per key that Spark pre-reduces on the map side), so a key holding a third of the feed costs one
  row per map task instead of landing whole in one task;
* ``first_cols`` come from the *first* row per key instead (``min_by``), for targets whose
  descriptive columns are fixed by the first insert (D11);
* matched keys take ``update_cols`` from the source and keep every other column; new keys take
  ``insert_cols`` (other columns null); untouched target rows are kept as they are;
* rows with a null key never match and are returned separately as rejects.

Parquet has no row-level MERGE; callers write the result as a new snapshot (see
``deskline.sources.sinks``) and use ``DataFrame.mergeInto`` where a catalog supports it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _q(c: str) -> str:
    return f"`{c}`"


def _struct(cols: Sequence[str]) -> str:
    return "struct(" + ", ".join(_q(c) for c in cols) + ")"


def dedupe_last(df: DataFrame, keys: Sequence[str], order_by: Sequence[str],
                first_cols: Sequence[str] = (), count_col: str | None = None) -> DataFrame:
    """One row per key: the last row in ``order_by`` (first row for ``first_cols``).

    Plain case: ``row_number() = 1`` over the key, newest first. Spark plans it with a *partial*
    ``WindowGroupLimit`` before the shuffle, so every map task forwards at most one row per key (a
    key holding a third of the feed does not land whole in one task), and the rows themselves are
    moved, not copied into aggregation buffers. With ``first_cols`` or a row count (U5) it is one
    ``max_by``/``min_by`` aggregate instead (partial aggregation gives the same skew property).
    Aggregate expressions are SQL text: one JVM call per column instead of one per operator.
    """
    keys, order_by = list(keys), list(order_by)
    if not first_cols and not count_col:
        w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order_by])
        return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    rest = [c for c in df.columns if c not in keys and c not in first_cols]
    order = _struct(order_by)
    aggs = [F.expr(f"max_by({_struct(rest)}, {order})").alias("_last")]
    if first_cols:
        aggs.append(F.expr(f"min_by({_struct(first_cols)}, {order})").alias("_first"))
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    out = df.groupBy(*keys).agg(*aggs)
    picked = {c: f"_last.{_q(c)}" for c in rest}
    picked.update({c: f"_first.{_q(c)}" for c in first_cols})
    exprs = [f"{picked.get(c, _q(c))} AS {_q(c)}" for c in df.columns]
    if count_col:
        exprs.append(_q(count_col))
    return out.selectExpr(*exprs)


def latest_rows(feed: DataFrame, keys: Sequence[str], order_by: Sequence[str], columns: Sequence[str],
                where: Column | None = None) -> DataFrame:
    """The current table a feed upserts into (last arrival per key), narrowed to ``columns`` and,
    optionally, to the rows satisfying the row predicate ``where``.

    With ``where``, only keys that have *some* feed row satisfying it are deduplicated (a
    ``left_semi`` join against those keys): a key whose latest row satisfies ``where`` always has
    such a row, so the result is exact while the wide aggregate only sees candidate keys. The
    semi join is a broadcast only when AQE measures the key set small.
    """
    keys = list(keys)
    cols = list(dict.fromkeys(keys + list(columns) + list(order_by)))
    rows = feed.select(*cols)
    if where is not None:
        cand = rows.filter(where).select(*keys).distinct()
        rows = rows.join(cand, keys, "left_semi")
    out = dedupe_last(rows, keys, order_by)
    if where is not None:
        out = out.filter(where)
    return out.select(*keys, *[c for c in columns if c not in keys])


def split_null_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with every key set, rows with a null key)."""
    ok = None
    for k in keys:
        c = F.col(k).isNotNull()
        ok = c if ok is None else ok & c
    return df.filter(ok), df.filter(~ok)


def load_new(table: DataFrame, source: DataFrame, keys: Sequence[str], order_by: Sequence[str],
             insert_cols: Sequence[str] | None = None, first_cols: Sequence[str] = (), stamp: Column | None = None,
             stamp_col: str = "LastUpdated", stamp_when_repeated: bool = False) -> tuple[DataFrame, DataFrame]:
    """``upsert`` into an *empty* ``table`` (only its schema is used): one dedupe, no join.

    Same result as ``upsert(empty, source, ...)``: columns the source lacks (or outside
    ``insert_cols``) are null; ``stamp_col`` is set only by the repeated-rows rule.
    """
    keys = list(keys)
    columns, schema = table.columns, table.schema
    data_cols = [c for c in columns if c not in keys and c != stamp_col]
    insert_cols = list(insert_cols if insert_cols is not None else data_cols)
    src_ok, rejects = split_null_keys(source, keys)
    src_cols = [c for c in source.columns if c in columns or c in order_by]
    src = dedupe_last(src_ok.select(*src_cols), keys, order_by, first_cols,
                      count_col="_n" if stamp_when_repeated else None)
    exprs = []
    for c in columns:
        typ = schema[c].dataType.simpleString()
        if c == stamp_col and stamp is not None:
            e = "_n > 1" if stamp_when_repeated else "false"
            exprs.append(f"{e} AS `_stamp_hit`")
            continue
        e = _q(c) if c in keys or (c in insert_cols and c in src_cols) else "NULL"
        exprs.append(f"CAST({e} AS {typ}) AS {_q(c)}")
    out = src.selectExpr(*exprs)
    return _apply_stamp(out, columns, schema, stamp, stamp_col, None), rejects


def _apply_stamp(df: DataFrame, columns, schema, stamp, stamp_col, keep_col) -> DataFrame:
    if stamp is None or stamp_col not in columns:
        return df
    other = F.col(keep_col) if keep_col else F.lit(None)
    v = F.when(F.col("_stamp_hit"), stamp).otherwise(other).cast(schema[stamp_col].dataType).alias(stamp_col)
    return df.select(*[v if c == stamp_col else F.col(c) for c in columns])


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order_by: Sequence[str],
           update_cols: Sequence[str] | None = None, insert_cols: Sequence[str] | None = None,
           first_cols: Sequence[str] = (), stamp: Column | None = None, stamp_col: str = "LastUpdated",
           stamp_when_repeated: bool = False) -> tuple[DataFrame, DataFrame]:
    """Apply ``source`` to ``target`` on ``keys``; returns ``(snapshot, rejects)``.

    ``target`` columns define the output schema. ``stamp`` (a literal run time) is written to
    ``stamp_col`` for matched keys -- and, with ``stamp_when_repeated``, also for new keys that had
    more than one source row (a row-by-row MERGE inserts the first and updates with the rest).
    The merge is one full outer join on the keys; its projection is SQL text.
    """
    keys = list(keys)
    out_cols, schema = target.columns, target.schema
    data_cols = [c for c in out_cols if c not in keys and c != stamp_col]
    update_cols = list(update_cols if update_cols is not None else data_cols)
    insert_cols = list(insert_cols if insert_cols is not None else data_cols)

    src_ok, rejects = split_null_keys(source, keys)
    src_cols = [c for c in source.columns if c in out_cols or c in order_by]
    src = dedupe_last(src_ok.select(*src_cols), keys, order_by, first_cols,
                      count_col="_n" if stamp_when_repeated else None)
    s_cols = src_cols + (["_n"] if stamp_when_repeated else [])

    t = target.selectExpr(*[f"{_q(c)} AS `t_{c}`" for c in out_cols], "true AS `_in_t`")
    s = src.selectExpr(*[f"{_q(c)} AS `s_{c}`" for c in s_cols], "true AS `_in_s`")
    cond = None
    for k in keys:
        c = F.col(f"t_{k}") == F.col(f"s_{k}")
        cond = c if cond is None else cond & c
    j = t.join(s, cond, "full_outer")

    both, only_s = "(_in_t AND _in_s)", "_in_s"
    exprs = []
    for c in out_cols:
        tc, typ = f"`t_{c}`", schema[c].dataType.simpleString()
        sc = f"`s_{c}`" if c in s_cols else "NULL"
        if c in keys:
            e = f"coalesce({tc}, {sc})"
        elif c == stamp_col and stamp is not None:
            hit = both + (" OR (_in_t IS NULL AND `s__n` > 1)" if stamp_when_repeated else "")
            exprs += [f"coalesce({hit}, false) AS `_stamp_hit`", f"{tc} AS `_stamp_keep`"]
            continue
        else:
            upd = sc if c in update_cols else tc
            ins = sc if c in insert_cols else "NULL"
            e = f"CASE WHEN {both} THEN {upd} WHEN {only_s} THEN {ins} ELSE {tc} END"
        exprs.append(f"CAST({e} AS {typ}) AS {_q(c)}")
    out = j.selectExpr(*exprs)
    return _apply_stamp(out, out_cols, schema, stamp, stamp_col, "_stamp_keep"), rejects


def empty_like(df: DataFrame, extra: dict[str, str] | None = None) -> DataFrame:
    """An empty target with ``df``'s schema (plus ``extra`` name -> type columns)."""
    cols = [F.col(c) for c in df.columns]
    for name, typ in (extra or {}).items():
        cols.append(F.lit(None).cast(typ).alias(name))
    return df.select(*cols).limit(0)
