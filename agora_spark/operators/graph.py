"""Connected components of an edge table by contraction, choices in order within them, and scratch tables for operators that work in rounds."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_made: list[tuple[SparkSession, str]] = []


def root(spark: SparkSession) -> str:
    """The folder that all executors share: that of spark.checkpoint.dir; only in local mode, where it is unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="agora-graph-"))
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder that all executors share, which cuts its lineage. It goes when drop() is given it, or when the process ends."""
    spark = df.sparkSession
    path = f"{root(spark)}/graph-{uuid.uuid4().hex}"
    _made.append((spark, path))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._agora_path = path
    return out


def held(df: DataFrame) -> DataFrame:
    """cut(), for a table that grows with the input: joins shuffle it. By its size as packed on disk it would be broadcast, many times larger, through the driver."""
    written = cut(df)
    out = written.hint("merge")
    out._agora_path = written._agora_path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of cut() that nothing will read again."""
    for df in tables:
        path = getattr(df, "_agora_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _made[:] = [x for x in _made if x[1] != path]


@atexit.register
def _at_exit() -> None:
    for spark, path in list(_made):
        with suppress(Exception):  # the session may have ended before the process
            _delete(spark, path)


def _rooted(pointers: DataFrame) -> DataFrame:
    """Pointers (node, to), of which roots point to themselves, followed to their roots: each round doubles the reach."""
    while True:
        further = pointers.select(F.col("node").alias("via"), F.col("to").alias("next"))
        jumped = cut(pointers.join(further, F.col("to") == F.col("via")).select("node", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        drop(pointers)
        pointers = jumped.select("node", "to")
        pointers._agora_path = jumped._agora_path
        if jumped.where("moved").isEmpty():
            return pointers


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of edges (a, b): the smallest node reachable.

    Each round points every node to its smallest neighbour, follows the pointers to their roots, and
    contracts the edges to the roots: what is settled takes no part in the next round, which has half
    the nodes at most. Ends of any one type will do, if it has an order.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not edges.isEmpty() or labels is None:
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.node", "e.other")
        roots = _rooted(cut(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("to"))))
        was, now = (roots.select(F.col("node").alias(f"n{x}"), F.col("to").alias(f"r{x}")) for x in "ab")
        fewer = cut(edges.join(was, F.col("a") == F.col("na")).join(now, F.col("b") == F.col("nb")).where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
        if labels is None:
            labels = roots
        else:
            after = cut(labels.join(was, F.col("to") == F.col("na"), "left").select("node", F.coalesce("ra", "to").alias("to")))
            drop(labels, roots)
            labels = after
        drop(edges)
        edges = fewer
    drop(edges)
    out = labels.select("node", F.col("to").alias("component"))
    out._agora_path = labels._agora_path
    return out


def in_order(rows: DataFrame, component: str, order: list[str], work, schema: str) -> DataFrame:
    """work(rows) -> rows over the rows of each component in their order, for choices that depend on those before.

    Rows pass in a stream, as dicts; work is a generator that gets the rows of one component. Components
    are worked on apart, so the data's longest chain costs no more rounds than another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for batch in batches for row in batch.to_pylist())
        out: list[dict] = []
        for _, group in groupby(stream, key=lambda r: r[component]):
            for row in work(group):
                out.append(row)
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_pylist(out)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out)

    return rows.repartition(component).sortWithinPartitions(component, *order).mapInArrow(run, schema)
