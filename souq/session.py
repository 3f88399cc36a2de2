"""Session construction and checkpoint-directory handling."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"

# Settings that matter at scale.  AQE re-plans joins from runtime sizes
# (broadcast only below the threshold, sort-merge otherwise), coalesces small
# shuffle partitions and splits skewed ones.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # remove reliable checkpoint files once their DataFrames are unreachable
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "souq", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's scale settings."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in SCALE_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names shared storage and is used as is (and is
    required).  Only a local-mode session without it (tests) gets a private
    scratch folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:              # Spark Connect: the server owns the setting
        sc = None
    path = spark.conf.get(_CKPT_KEY, None) or (sc.getConf().get(_CKPT_KEY, None) if sc else None)
    if sc is None:
        if not path:
            raise RuntimeError(f"set {_CKPT_KEY} to a folder on shared storage")
        return path
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {_CKPT_KEY} to a folder on shared storage; "
                               "a machine-local folder cannot hold checkpoints on a cluster")
        path = tempfile.mkdtemp(prefix="souq-ckpt-")
        spark.conf.set(_CKPT_KEY, path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A location under the checkpoint folder for written intermediate tables."""
    return os.path.join(ensure_checkpoint_dir(spark), name)


def scale_settings(input_bytes: int, total_cores: int, partition_bytes: int = 256 * 1024 * 1024,
                   shuffled_share: float = 0.05, max_reducers: int = 20_000) -> dict[str, str]:
    """Settings that keep partitions a few hundred MB at a given input size.

    Shuffles carry a few pruned columns, so reducers are sized from the bytes
    that are shuffled (``shuffled_share`` of the input), never fewer than two
    per core and never more than ``max_reducers`` (map output metadata grows
    with mappers times reducers).  Input splits grow so that there are about
    a hundred per core at most.  AQE coalesces reducers after measuring the
    real map output; skewed partitions beyond 4x the median and 1 GB are split.
    """
    parts = max(2 * total_cores, min(max_reducers, -(-int(input_bytes * shuffled_share) // partition_bytes)))
    split = max(partition_bytes, -(-input_bytes // (100 * total_cores)))
    split_mb = f"{-(-split // (1024 * 1024))}m"
    mb = f"{partition_bytes // (1024 * 1024)}m"
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": mb,
        "spark.sql.files.maxPartitionBytes": split_mb,
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    }
