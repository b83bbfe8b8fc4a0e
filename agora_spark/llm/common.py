"""Shared scratch tables and small helpers of the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str, str]] = []
_owner = ""
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir. Where that is unset on one machine (tests), a
    temporary folder is made once for this process; elsewhere it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="agora-"))
    return _own[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and return the written table.

    This cuts the lineage: a lost executor costs a reread, not a recomputation, and several readers
    share the work. The table goes when release() is given it, or when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/agora-{label}-{uuid.uuid4().hex}"
    _made.append((spark, path, _owner))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._agora_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read again."""
    for df in tables:
        path = getattr(df, "_agora_path", None)
        if path:
            _delete(df.sparkSession, path)


@contextmanager
def owned_by(owner: str) -> Iterator[None]:
    """Tables of materialize() made inside belong to owner."""
    global _owner
    before, _owner = _owner, owner
    try:
        yield
    finally:
        _owner = before


def release_owned(owner: str) -> None:
    """Delete the tables of an owner; for when all results that read them are written."""
    for spark, path, whose in list(_made):
        if whose == owner:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
    _made[:] = [x for x in _made if x[1] != path]


@atexit.register
def _at_exit() -> None:
    for spark, path, _ in list(_made):
        with suppress(Exception):  # the session may have ended before the process
            _delete(spark, path)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, that gives its memory back when a task ends: Python workers live on and serve later tasks."""

    @wraps(run)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tidy()

    return work


def tidy() -> None:
    """Give free memory of Arrow and of the C library back to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # malloc_trim is glibc's own
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
