"""Folders that all machines of a cluster share, and file systems by URI."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """A new folder's URI below spark.checkpoint.dir, or SparkContext's checkpoint folder; where neither is set, below a temporary
    one if all runs on this machine, else an error: executors elsewhere would not see it."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir() or own_root(context.master)
    return f"{root.rstrip('/')}/postlane-{uuid.uuid4().hex}"


def own_root(master: str) -> str:
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines of the cluster share")
    if not _OWN:
        path = tempfile.mkdtemp(prefix="postlane-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN.append(f"file://{path}")
    return _OWN[0]


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def saved(df: DataFrame) -> DataFrame:
    """`df` written once as a table in a shared folder and read back: its lineage ends there, and lost executors cost no rerun."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
