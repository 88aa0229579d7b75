"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # parquet scans: 128 MiB splits keep a task's input well inside executor memory
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def local_session(cores: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "tidemark", extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench (local mode); clusters bring their own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or (cores if isinstance(cores, int) else 8))
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the deployment (a shared filesystem path) and we only
    read it.  Only when it is unset (local tests) do we pick a scratch folder of our own.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="tidemark-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, prefix: str) -> str:
    """A fresh path under the shared checkpoint folder (any Hadoop filesystem URI).

    Nothing is created here: Spark writers create the directory on the shared
    filesystem, so no machine-local temporary folder is ever used on a cluster.
    """
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{prefix}{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once under the shared checkpoint folder and read from there by whatever uses them."""
    path = scratch_path(df.sparkSession, f"{name}-")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, kept once in the checkpoint folder in the order and partitions they have: seeded learners draw by these."""
    ensure_checkpoint_dir(df.sparkSession)
    kept = df.persist()   # a cached plan's partitions aren't coalesced
    try:
        return kept.checkpoint(eager=True)
    finally:
        kept.unpersist()
