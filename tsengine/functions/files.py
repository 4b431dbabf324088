"""Folders and files that driver and executors share."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a local one for a local master and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: computed once, and not again where an executor is lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sha256_of(path: str, block: int = 8 << 20) -> str:
    """The digest of a file, read in blocks; any store that pyarrow reaches by URI, a plain path is local."""
    from urllib.parse import quote

    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    store, path = fs.FileSystem.from_uri(quote(path, safe="/:@%")) if "://" in path else (fs.LocalFileSystem(), path)
    digest = hashlib.sha256()
    with store.open_input_stream(path) as f:
        while data := f.read(block):
            digest.update(data)
    return digest.hexdigest()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with this text as a whole, or not at all if it is there already; of several writers exactly one succeeds.

    The text is written to a hidden file beside it first. On local disks that is linked to the name, elsewhere renamed to it, which file systems with atomic renames (HDFS) refuse where the
    name exists. Stores without such renames need a committer of their own.
    """
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = there.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(there.getParent())
    draft = spark._jvm.org.apache.hadoop.fs.Path(there.getParent(), f".{there.getName()}-{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write(text.encode())
    out.close()
    if store.getUri().getScheme() != "file":
        return store.rename(draft, there)
    try:
        os.link(draft.toUri().getPath(), there.toUri().getPath())
    except FileExistsError:
        return False
    finally:
        store.delete(draft, False)
    return True


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
