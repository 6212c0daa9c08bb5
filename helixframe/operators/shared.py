"""Folders that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def folder(spark: SparkSession, label: str) -> str:
    """A fresh name in this application's folder under spark.checkpoint.dir, which goes when the driver's JVM ends.

    Where that is unset, a temporary folder serves a local session; on a cluster it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='helixframe-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    key = f"{root} {spark.sparkContext.applicationId}"
    if key not in _roots:
        _roots[key] = f"{root.rstrip('/')}/reads-{uuid.uuid4().hex}"
        where, files = hadoop(spark, _roots[key])
        files.mkdirs(where)
        files.deleteOnExit(where)  # also after spark.stop()
    return f"{_roots[key]}/{label}-{uuid.uuid4().hex}"


def hadoop(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = hadoop(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, files = hadoop(spark, path)
    files.delete(where, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """A rename is the commit; it fails rather than move into a folder that is already there."""
    where, files = hadoop(spark, source)
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    if files.exists(to) or not files.rename(where, to):
        raise OSError(f"{source} can't be renamed to {target}")


def parts(rows: DataFrame, bytes_each: int, least: int | None = None) -> int:
    """Shuffle partitions so that their number grows with the optimizer's estimate of the rows, which is in proportion to the files they come from; the session's number, or `least`, at least."""
    least = least or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, -(-size // bytes_each)) if size < 1 << 50 else least  # beyond that there is no estimate
