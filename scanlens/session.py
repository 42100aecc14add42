"""Session helpers: building a local session for tests and resolving the checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # no call site per Column operation: long expressions (snippets) build ten times faster
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # inner recognition libraries hold one thread each; Spark owns the parallelism
    "spark.executorEnv.OMP_THREAD_LIMIT": "1",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "scanlens") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", "16g")
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and job-owned tables.

    Read from ``spark.checkpoint.dir``. Only a local-mode session without the setting gets a fresh
    temporary folder (tests); on a cluster the setting is required, since a machine-local folder
    does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    conf = sc.getConf()
    path = conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on the cluster")
        path = tempfile.mkdtemp(prefix="scanlens-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path.rstrip("/")
