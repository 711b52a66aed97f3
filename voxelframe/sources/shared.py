"""The folder that driver and executors share, for tables that a job writes and reads again."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary one on a local master, and an error on a cluster.

    Executors of a cluster don't share the driver's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="voxelframe-"))
    return "file://" + _LOCAL[0]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the session's file systems; one that is already gone is no error."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name in the shared folder, deleted when the application ends."""
    path = f"{shared_dir(spark)}/voxelframe-{name}-{uuid.uuid4().hex}"

    def close():
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the session has ended before; its folder goes with the cluster's clean-up
            pass

    atexit.register(close)
    return path
