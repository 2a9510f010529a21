"""Session helpers.

The library never creates a global session on import; callers pass a SparkSession in.
`local_session` is for tests and the bench only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Conf key for the prefix-scan chunk size (rows per chunk of one group); see operators/scan.py.
ROWS_PER_CHUNK_KEY = "tunesmith.scan.rowsPerChunk"
DEFAULT_ROWS_PER_CHUNK = 2_000_000


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tunesmith") -> SparkSession:
    """A local session configured like the cluster one (AQE on, UTC, UI off)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.scheduler.mode", "FAIR")  # settings that are evaluated side by side share the cores
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TUNESMITH_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only a local-mode session without that setting gets a private folder (tests, bench).
    On a cluster the setting must come from the deployment; a machine-local folder would
    not survive the loss of an executor, so we refuse to invent one.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder before running tunesmith jobs")
    path = tempfile.mkdtemp(prefix="tunesmith-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def rows_per_chunk(spark: SparkSession) -> int:
    return int(spark.conf.get(ROWS_PER_CHUNK_KEY, str(DEFAULT_ROWS_PER_CHUNK)))


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def materialize(df, name: str = "table"):
    """Cut lineage by writing ``df`` as Parquet under the shared checkpoint folder and reading it back.

    Used where a result is read by several later branches (a prefix scan reads its input
    twice), so the upstream plan runs once, and a lost executor re-reads files instead of
    recomputing from the raw tables. Unlike ``Dataset.checkpoint`` the plan is computed
    once (no count-then-write double pass) and re-reads get column pruning and pushdown.

    The table goes when the driver ends, or earlier through ``release``.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/tunesmith-tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    fs, hpath = _hadoop_path(spark, path)
    fs.deleteOnExit(hpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._materialized_at = path
    return out


def release(*tables) -> None:
    """Delete materialized tables that no later step reads."""
    for df in tables:
        path = getattr(df, "_materialized_at", None)
        if path is not None:
            fs, hpath = _hadoop_path(df.sparkSession, path)
            fs.delete(hpath, True)
