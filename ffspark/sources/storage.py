"""Where intermediate tables go, and small files by which concurrent runs agree."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under ``spark.checkpoint.dir``. Where that is unset, a session on one machine gets a folder of its own;
    a cluster has none to share, so that is an error there."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    fs, p = file_system(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def claim(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a small file holding ``text``, unless it exists: of several callers at once exactly one gets True.

    The file system decides, by creation without overwriting. Hadoop's own local one does not check and create in one
    step, so local paths are opened exclusively instead."""
    fs, p = file_system(spark, path)
    fs.mkdirs(p.getParent())
    folder = fs.resolvePath(p.getParent())
    if folder.toUri().getScheme() == "file":
        try:
            with os.fdopen(os.open(f"{folder.toUri().getPath()}/{p.getName()}", os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True
    try:
        stream = fs.create(p, False)
    except Py4JJavaError:
        if fs.exists(p):
            return False
        raise
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def text_of(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    with contextlib.closing(stream):
        return bytes(stream.readAllBytes()).decode()
