"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Configuration applied to sessions this package creates.  On a cluster the
# session already exists and these are not touched (``getOrCreate`` keeps
# the cluster's settings); they matter for local runs and tests.
LOCAL_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.sql.shuffle.partitions": "8",
    "spark.default.parallelism": "8",
    "spark.python.worker.reuse": "true",
}


def get_spark(master: str | None = None, app: str = "cadenza", **conf) -> SparkSession:
    """Return the active session or build a local one.

    ``master`` defaults to ``local[$BENCH_CPUS]`` (8 when unset).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    settings = dict(LOCAL_CONF)
    settings["spark.sql.shuffle.partitions"] = cpus
    settings["spark.default.parallelism"] = cpus
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The run's own folder, by application id, for intermediate tables, stream
    results and their checkpoints, inside the folder that driver and executors
    share.  :func:`clear_intermediate` deletes it."""
    return f"{shared_folder(spark).rstrip('/')}/cadenza-{spark.sparkContext.applicationId}"


def clear_intermediate(spark: SparkSession) -> bool:
    """Delete what this run has written to its folder; results that are still
    to be read from it are lost.  Whether there was anything."""
    jvm, path = spark.sparkContext._jvm, checkpoint_dir(spark)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return bool(folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True))


def shared_folder(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session (the cluster names a
    shared folder there).  Where it is unset, a fresh scratch folder is
    created and registered for ``local[...]`` masters only; on a cluster a
    folder of one machine would lose rows, so that raises.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="cadenza-ckpt-")
        sc.setCheckpointDir(path)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path
