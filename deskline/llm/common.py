"""Helpers shared by the operators of this package: table paths and stored intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deskline.session import drop_finished_shuffles, ensure_checkpoint_dir  # noqa: F401 -- the first is for the operators


_SHIPPED: set[str] = set()


BATCH_ROWS = 256  # rows handed to Python at once: whole texts, so far fewer than Spark's 10,000


def prepare(spark: SparkSession) -> None:
    """Settings and code that tasks running Python need.

    Arrow batches hold ``BATCH_ROWS`` rows unless the session has its own number. The package's code
    goes to the executors once an application, as ``--py-files`` would do it: tasks import it by name
    and an executor need not have the repository."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not os.path.isdir(package):
        return  # imported from an archive, which whoever imported it has shipped
    path = os.path.join(tempfile.mkdtemp(prefix="deskline-code-"), f"deskline_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join("deskline", os.path.relpath(full, package)))
    context.addPyFile(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark (the folder may be in a store that only Spark opens)."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BROADCAST_ROWS = 1 << 21  # rows of one or two narrow columns that are broadcast; larger tables are shuffled


def small(df: DataFrame) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if it was counted to be within bounds."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def most_frequent(counts: DataFrame, count_col: str, limit: int) -> DataFrame:
    """The rows of a stored count table with the largest counts, ``limit`` at most, whole ranges of counts.

    Only the row numbers of a few hundred logarithmic ranges reach the driver, however many tasks there
    are; then the ranges from the top that fit are taken whole, so ties never need an order."""
    steps = 16  # ranges for each doubling
    part = F.floor(F.log2(F.col(count_col).cast("double")) * steps).cast("int")
    sizes = sorted(((r["b"], r["n"]) for r in counts.groupBy(part.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
                    if r["b"] is not None), reverse=True)
    total, least = 0, None
    for b, n in sizes:
        total += n
        if total > limit:
            break
        least = b
    return counts.filter(part >= least) if least is not None else counts.limit(0)


def ascii_lower(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc32_text(col: Column) -> Column:
    """crc32 of the value written as text (the contracts' fold number); null counts as empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))
