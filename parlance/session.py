"""Session helpers: building a local session for tests and bench, and the
checkpoint directory used to cut lineage.

On a cluster the checkpoint folder is whatever ``spark.checkpoint.dir``
names (a shared file system). Only when that setting is absent (local
tests, the bench) do we pick a scratch folder of our own.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Signals can be wide rows; keep Arrow batches small (see functions.signal).
    "spark.sql.execution.arrow.maxRecordsPerBatch": "64",
    # a checkpoint's files go when no frame reads them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "parlance",
              shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    settings = dict(_DEFAULT_CONF)
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions or cpus)
    settings["spark.driver.memory"] = "16g"
    settings.update(conf)
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point the context at ``spark.checkpoint.dir``. A scratch folder is set
    only on a local master that has none (tests, local bench); on a cluster
    its files would lie where other machines do not see them, so there a
    missing setting is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="parlance-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def stable(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: writes ``df`` to the checkpoint folder and cuts the
    lineage, so values that depend on partition layout (partition ids,
    monotonically increasing ids) are fixed before they are used twice and
    survive a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)

