"""Paths of the local file system, and of any file system Spark knows where they have a scheme (hdfs://, s3a:// ...)."""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import SparkSession


def is_remote(path: str) -> bool:
    return "://" in path


def hadoop(path: str):
    """The file system of a path and the path as it takes it."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError(f"no session is active, so {path} cannot be reached")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(path: str) -> bool:
    if not is_remote(path):
        return os.path.exists(path)
    fs, where = hadoop(path)
    return fs.exists(where)


def is_file(path: str) -> bool:
    if not is_remote(path):
        return os.path.isfile(path)
    fs, where = hadoop(path)
    return fs.exists(where) and fs.getFileStatus(where).isFile()


def real(path: str) -> str:
    """One spelling for each file."""
    if not is_remote(path):
        return os.path.realpath(path)
    fs, where = hadoop(path)
    out = fs.makeQualified(where).toString()
    return os.path.realpath(out.removeprefix("file:")) if out.startswith("file:") else out


def child(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}" if is_remote(folder) else os.path.join(folder, name)


def status(path: str) -> dict:
    """Where a file is, its size and when it was changed."""
    if is_remote(path):
        fs, where = hadoop(path)
        s = fs.getFileStatus(where)
        full, size, seconds = path, s.getLen(), s.getModificationTime() / 1000
    else:
        s = os.stat(path)
        full, size, seconds = os.path.abspath(path), s.st_size, s.st_mtime
    return {"path": full, "size_bytes": size, "modified_utc": datetime.fromtimestamp(seconds, timezone.utc).isoformat(timespec="seconds")}


def publish(local: str, path: str) -> None:
    """Bring a local file to a remote path: uploaded beside it, then renamed."""
    fs, where = hadoop(path)
    beside = where.suffix(".part")
    fs.copyFromLocalFile(False, True, hadoop(f"file://{local}")[1], beside)
    if fs.exists(where):
        fs.delete(where, False)
    fs.rename(beside, where)
