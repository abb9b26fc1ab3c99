"""Exact row numbers inside groups of any size.

Rows are cut into ranges of the whole sort order (``repartitionByRange``: bounds from a sample, so the
ranges are of similar size however the groups are), sorted inside their range and stored with their
place in it. A small table of counts by (group, range) then gives each range its offset. No task sorts
or holds a whole group, and the numbers depend on the rows alone, not on how many ranges there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from deskline.session import ensure_checkpoint_dir

_ROW_BITS = 33  # monotonically_increasing_id: the partition's number stands above these bits


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps see the same rows whatever is lost."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dense_number(df: DataFrame, by: Sequence[str], order_by: Sequence[str], name: str,
                 size: str | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with ``name``: a number from 0 without gaps inside each group of ``by``, following ``order_by``
    (ascending, nulls first); ``size``, if named, is the number of rows of the group.

    Null values of ``by`` are a group. Rows equal in ``by`` and ``order_by`` are numbered one after the
    other in no set order, and a crowd of them is split over ranges like any other rows. ``ranges`` is the number
    of sorting tasks (default: the session's shuffle partitions); it does not change a number.
    """
    by, order_by = list(by), list(order_by)
    spark = df.sparkSession
    # Stored before they are cut, so that a lost task meets the same rows in the same places again.
    rows = stored(df.withColumn("_tie", F.monotonically_increasing_id()), "rows")
    sort = [F.col(f"`{c}`").asc_nulls_first() for c in [*by, *order_by, "_tie"]]
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = rows.repartitionByRange(n, *sort).sortWithinPartitions(*sort).drop("_tie")
    cut = stored(cut.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    cut = cut.withColumn("_range", F.shiftright("_at", _ROW_BITS))

    group = [F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate(by)]
    names = [f"_g{i}" for i in range(len(by))]
    pieces = cut.groupBy(*group, F.col("_range").alias("_r")).agg(
        F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_k"))
    whole = Window.partitionBy(*names)
    before = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*names, "_r", "_first", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"),
                           F.sum("_k").over(whole).alias("_size"))
    on = F.col("_range") == F.col("_r")
    for c, g in zip(by, names):
        on = on & F.col(f"`{c}`").eqNullSafe(F.col(g))
    out = cut.join(pieces, on).withColumn(name, F.col("_before") + F.col("_at") - F.col("_first"))
    if size:
        out = out.withColumn(size, F.col("_size"))
    return out.drop("_at", "_range", "_r", "_first", "_before", "_size", *names)
