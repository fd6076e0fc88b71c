"""Session helpers: local sessions for tests/bench, checkpoint directory policy."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "ragloom") -> SparkSession:
    """A local session configured like the tests and the bench expect.

    On a cluster, build the session with the cluster's own settings instead;
    nothing in the library depends on these values.
    """
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("RAGLOOM_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.ansi.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``ragloom`` importable on executors (Python UDF workers import the functions
    they run by module name): zip the package once per SparkContext and ``addPyFile`` it."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="ragloom-pkg-"), "ragloom.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith((".py", ".txt")):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


_CHECKPOINTS: dict = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and streaming checkpoints, one per application.

    ``spark.checkpoint.dir`` names it. When that is unset a temporary folder is used, but
    only where driver and executors are one process (``local``, ``local[n]``): any other
    master raises, because a machine-local folder would lose the executors' files.
    """
    sc = spark.sparkContext
    if sc.applicationId in _CHECKPOINTS:
        return _CHECKPOINTS[sc.applicationId]
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    existing = sc._jsc.sc().getCheckpointDir()
    if not path and existing.isDefined():
        path = existing.get()
    elif not path:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="ragloom-ckpt-")
    if not existing.isDefined():
        sc.setCheckpointDir(path)
    _CHECKPOINTS[sc.applicationId] = os.path.join(path, f"ragloom-{sc.applicationId}")
    return _CHECKPOINTS[sc.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the checkpoint folder for written intermediate tables."""
    return os.path.join(checkpoint_dir(spark), name)


def release_scratch(spark: SparkSession) -> None:
    """Delete every intermediate table this application wrote (call it when its results
    have been stored; results not yet computed read those tables)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(checkpoint_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
