"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# What the jobs of this library expect from a session. Skew joins and rebalanced writes are
# split by adaptive execution, so it has to stay on; ANSI mode makes a value that does not fit
# its column an error. The call-site capture of PySpark costs
# several round trips to the JVM for every expression.
JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.compression.codec": "snappy",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_TARGET_BYTES = 200 * 1024 * 1024


def shuffle_partitions(shuffled_bytes: int, cores: int) -> int:
    """Initial shuffle partition count for a job that moves ``shuffled_bytes``.

    One partition per 200 MiB, at least two per core; adaptive execution merges what turns
    out to be small, but it cannot split the ordinary partition of an aggregate.
    """
    by_size = -(-shuffled_bytes // SHUFFLE_TARGET_BYTES)
    return max(by_size, 2 * cores)


def cluster_conf(shuffled_bytes: int, cores: int) -> dict[str, str]:
    """Session settings for a cluster of ``cores`` whose largest shuffle moves ``shuffled_bytes``.

    Scans are cut into tasks of a quarter GiB, merged shuffle partitions and rebalanced
    files aim at the same size.
    """
    return JOB_CONF | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions(shuffled_bytes, cores)),
        "spark.sql.files.maxPartitionBytes": "256MB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256MB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }


def local_session(cores: int | str, app: str = "lakeweave", conf: dict[str, str] | None = None) -> SparkSession:
    """Single-process session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in {**JOB_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def workspace(spark: SparkSession) -> str:
    """Fresh folder, visible to every executor, for tables a job writes on the way.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Only a session that
    runs in one process may do without it.
    """
    leaf = f"lakeweave-{uuid.uuid4().hex}"
    shared = spark.conf.get(CHECKPOINT_DIR, None)
    if shared:
        return f"{shared.rstrip('/')}/{leaf}"
    if re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
        return f"{tempfile.mkdtemp(prefix='lakeweave-')}/{leaf}"
    raise ValueError(f"set {CHECKPOINT_DIR} to a folder all executors share")
