"""Tables that an operator writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []
_open: list[list[str]] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder in local mode and an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="breathline-"))
    return _local[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/breathline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: cheap to read twice, and not lost with an executor."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession):
    """Deletes what :func:`written` wrote inside it at its end; results must be stored by then."""
    _open.append([])
    try:
        yield
    finally:
        jvm = spark._jvm
        for path in _open.pop():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
