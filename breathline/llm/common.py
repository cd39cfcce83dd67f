"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at a time inside a worker, so that memory follows this bound
#: and not the number of rows in an Arrow batch.
SLICE_CHARS = 2_000_000
#: Rows of a batch whose texts a worker holds as Python strings at a time.
PART_ROWS = 1_000

_fallback: list[str] = []
_scopes: list[list[str]] = []
_kept: list[dict] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session; a temporary folder is used
    only where that is unset, which is the case in local tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _fallback:
        _fallback.append(tempfile.mkdtemp(prefix="breathline-"))
    return _fallback[0]


def materialise(df: DataFrame, name: str, keep: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet below the shared folder; the reread table and its path.

    A written table cuts the lineage and survives the loss of executors. It is
    deleted at the end of the innermost :func:`scratch`, unless it is to be kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/breathline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes and not keep:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by :func:`materialise` that nothing reads any more."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the tables written inside it when it ends; results must be written by then."""
    _scopes.append([])
    try:
        yield
    finally:
        discard(spark, *_scopes.pop())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(texts: list, limit: int = SLICE_CHARS):
    """Yield (from, to) index pairs whose texts hold about ``limit`` characters."""
    start = size = 0
    for k, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def parts(batches: Iterator[pa.RecordBatch], rows: int = PART_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches' rows in pieces of at most ``rows``."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch  # not held while the next one arrives


def kept() -> dict:
    """What a worker keeps between tasks, until a stage that doesn't use it calls :func:`release`."""
    _kept.append({})
    return _kept[-1]


def release(*but: dict) -> None:
    """Give back what earlier stages left in this worker: what they kept, and memory that is free but held."""
    for own in _kept:
        if not any(own is b for b in but):
            own.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, taken) -> str:
    """A column name like ``name`` that, in any case, isn't taken."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = f"_{name}"
    return name


#: A key is hot if it holds more than this share of all rows, one in so many, and more rows
#: than a task takes easily. There are at most HOT hot keys.
HOT, HOT_ROWS = 1_000, 100_000


def has_hot(keyed: DataFrame, size: str, total: int) -> bool:
    """Whether a key's number of rows ``size`` makes it hot among ``total`` rows, or more."""
    return total > HOT_ROWS and not keyed.where((F.col(size) * HOT > total) & (F.col(size) > HOT_ROWS)).isEmpty()


def with_hot(rows: DataFrame, keyed: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``keyed``, one row a key, whose column ``size`` is the key's number of rows.

    ``total`` is the number of rows, or more. Hot keys, HOT of them at most, are
    broadcast; the others are joined by a shuffle, in which no key is large. ``size``
    is kept. ``rows`` and ``keyed`` are read more than once where there are hot keys.
    """
    if not has_hot(keyed, size, total):
        return rows.join(keyed, key, how)
    is_hot = (F.col(size) * HOT > total) & (F.col(size) > HOT_ROWS)
    hot = F.broadcast(keyed.where(is_hot))
    rest = rows.join(hot.select(key), key, "left_anti").join(keyed.where(~is_hot), key, how)
    return rows.join(hot, key).unionByName(rest)
