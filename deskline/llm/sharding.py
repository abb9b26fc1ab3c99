"""Proportional stratified interleaving into shards (operator 9), DataFrame functions only.

Rows are put in a seeded pseudo-random order inside their source; row r of a source of n rows gets
the fractional rank (r - 1/2) / n. All rows sorted by fractional rank are cut into shards of equal
counts, so every shard holds every source in its share of the whole.

Ranks are found without ever sorting a whole source (or everything) in one task: rows are cut into
ranges of the *whole* sort order, numbered inside them, and a range's offset is the running count of
those before it. So many sources of one row, or one id on every row, are split like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deskline.operators.ranking import dense_number, stored

CELL_ROWS = 20_000  # expected rows of a range, the unit one task sorts


def seeded_key(seed: int, key: Column) -> Column:
    """Pseudo-random sort key of a row: md5 of ``seed:key`` (hex); null keys count as empty text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def assign_shards(rows: DataFrame, id_col: str, source_col: str, shards: int, seed: int = 17,
                  carry: list[str] | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``carry`` columns, ``shard`` (int) and ``slot`` (from 0).

    Shard sizes differ by one row at most; each shard holds a source's share to within two rows.
    The result depends on ids, sources and seed only. A null source is a source of its own; a null
    id counts as empty text; rows that repeat an id are separate rows, ordered by ``carry`` (which
    of two fully equal rows comes first makes no difference). An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    carry = carry or []
    own = rows.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                      *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    keyed = own.withColumn("_key", seeded_key(seed, F.col("_id")))
    ties = ["_key", "_id", *[f"_c{i}" for i in range(len(carry))]]
    keyed = stored(keyed, "shard_keys")  # narrow rows: later steps never read the input again
    total = keyed.count()
    cells = max(1, -(-total // CELL_ROWS))
    in_source = dense_number(keyed, ["_source"], ties, "_rank", size="_total", ranges=cells)
    shared = in_source.withColumn("_share", (F.col("_rank") * 2 + 1) / (F.col("_total") * 2).cast("double"))
    placed = dense_number(shared.drop("_rank", "_total"), [], ["_share", "_source", *ties], "_place", ranges=cells)
    # exact integer cut: shard s begins at ceil(s * total / shards)
    shard = F.expr(f"(_place * {shards}L) div {max(1, total)}L")
    first = F.expr(f"(_shard * {total}L + {shards - 1}L) div {shards}L")
    return (placed.withColumn("_shard", shard).withColumn("_slot", F.col("_place") - first)
            .select(F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
                    F.col("_shard").cast("int").alias("shard"), F.col("_slot").cast("long").alias("slot")))
