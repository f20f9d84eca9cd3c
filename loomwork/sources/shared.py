"""Folders that driver and executors share, and files in them by any path that Spark or Arrow writes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``.

    Where that isn't set, a session of one JVM gets a folder that goes with the
    process; on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="loomwork-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        base = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(path: str):
    """(filesystem, path in it): any store that Arrow knows; plain paths and ``file:`` URLs are local."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def url(path: str) -> str:
    """One spelling of a path: local ones as ``file:///...``."""
    if path.startswith("file:"):
        return "file:///" + path[len("file:") :].lstrip("/")
    return path if "://" in path else f"file://{os.path.abspath(path)}"
