"""Shared helpers: scratch tables in the shared checkpoint folder, remote files, input columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.session import checkpoint_dir, literal_rows as small_table, ship


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the session's shared checkpoint folder (one per call)."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, column
    pruning and filters still reach the files, and a lost executor costs nothing. Returns the
    frame and its path (for ``drop``)."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no live plan reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly two columns ``doc_id`` (long) and ``text``, whatever else the input carries.
    Also ships the package to the workers."""
    ship(df.sparkSession)
    return df.select(df[id_col].cast("long").alias("doc_id"),
                     df[text_col].cast("string").alias("text"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have yet (case-insensitive)."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name = "_" + name
    return name


def open_fs(uri: str):
    """(filesystem, path) of a folder for tasks that read and write raw bytes. ``file:/x`` and
    plain paths are local or mounted shared folders; s3://, gs:// and hdfs:// go to Arrow's own
    clients."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def task_label() -> str:
    """Partition and attempt of the running task: names that no two attempts share."""
    from pyspark import TaskContext
    c = TaskContext.get()
    return f"{c.partitionId():06d}-{c.taskAttemptId()}"


__all__ = ["ship", "scratch", "written", "drop", "id_and_text", "free_name", "small_table", "open_fs", "task_label"]
