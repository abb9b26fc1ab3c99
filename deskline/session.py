"""Session settings shared by every job."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def ensure_session(spark: SparkSession) -> SparkSession:
    """Pin the settings every operator relies on.

    All stamps are read and written as UTC wall-clock; AQE stays on so joins against small
    dimension tables become broadcasts by measured size, and skewed shuffle partitions are split.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder (``spark.checkpoint.dir``), registered with the context so
    ``DataFrame.checkpoint()`` writes there. Unset, it is an error on a cluster; a session whose tasks run
    in this very process (master ``local``) gets a temporary folder."""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- Spark Connect: no SparkContext, the conf is all there is
        sc = None
    base = spark.conf.get("spark.checkpoint.dir", None) or (sc.getCheckpointDir() if sc else None)
    master = spark.conf.get("spark.master", "")
    if not base and master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not base:  # one machine: driver and tasks share its folders
        base = tempfile.mkdtemp(prefix="deskline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if sc is not None and not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh directory under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir`` (or the context's checkpoint dir); see
    ``ensure_checkpoint_dir`` for sessions that set neither.
    """
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path or path.startswith("file:"):
        os.makedirs(path.replace("file:", "", 1), exist_ok=True)
    return path


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps now. It does so when the driver
    collects garbage, which a driver with little to do may put off for longer than the disks last."""
    gc.collect()
    jvm = getattr(spark, "_jvm", None)
    if jvm is not None:
        jvm.System.gc()


def scale_settings(input_bytes: int, cores: int, partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Submit-time settings for a run over ``input_bytes`` on ``cores`` executor cores.

    Shuffle partitions: enough for ~``partition_bytes`` each (at least 2 waves of the cores); AQE
    coalesces what turns out small and splits skewed partitions; broadcasts only happen below the
    run-time measured threshold.
    """
    parts = max(2 * cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
        "spark.sql.session.timeZone": "UTC",
    }
