"""Session helpers.

The library never creates its own cluster configuration: it reads what the
session already has.  ``get_spark`` is for tests, benches and scripts only.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, partitions: int = 8, app: str = "docrevise") -> SparkSession:
    """Local session used by tests and the bench (UI off, UTC, AQE on)."""
    master = master or os.environ.get("DOCREVISE_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
        .config("spark.checkpoint.compress", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # whole documents cross into the Python stages: keep Arrow batches modest
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        # call sites of column expressions cost several JVM round trips each
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DOCREVISE_DRIVER_MEMORY", "4g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  When it is unset, a single-process ``local`` master (tests, bench)
    gets a scratch folder; any other master raises, because a machine-local
    folder would be written by each host on its own.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="docrevise-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", current)
        except Exception:  # some deployments lock core settings at run time
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A path below the shared checkpoint folder, for written tables."""
    base = ensure_checkpoint_dir(spark)
    return base.rstrip("/") + "/" + name


def path_complete(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds a finished write (its ``_SUCCESS`` marker),
    on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the cluster's default file system where it
    names none, so that Spark and files written by tasks mean one place."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def file_store(url: str):
    """(Arrow file system, path) of a qualified URL, for use inside tasks."""
    from pyarrow import fs
    if url.startswith("file:"):
        return fs.LocalFileSystem(), "/" + url[5:].lstrip("/")
    return fs.FileSystem.from_uri(url.replace("s3a://", "s3://", 1))
