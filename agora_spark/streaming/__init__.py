"""Structured Streaming twins of the engagement operators and of the lake writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora_spark.functions.dates import local_day


def like_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Likes, one per user, venue and local day, within the time that late events are waited for."""
    rows = events.where("event_type = 'click'").withColumn("day", local_day(F.col("ts"))).withWatermark("ts", late)
    return rows.dropDuplicatesWithinWatermark(["user_id", "venue_id", "day"])


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events by UTC hour and type."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def write_lake(envelopes: DataFrame, path: str, checkpoint: str, every: str = "900 seconds", at_once: bool = False):
    """Start writing envelopes as gzipped JSON lines by source, dataset, day and hour."""
    writer = envelopes.writeStream.format("json").option("compression", "gzip").option("path", path).option("checkpointLocation", checkpoint).partitionBy("source", "dataset", "dt", "hour")
    return writer.trigger(**({"availableNow": True} if at_once else {"processingTime": every})).start()


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the snapshots under a path that were written whole, in order."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return []
    names = (x.getPath().getName() for x in fs.listStatus(place))
    whole = lambda n: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))
    return sorted(int(n) for n in names if n.isdigit() and whole(n))


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest snapshot of upsert_latest()."""
    found = snapshots(spark, path)
    return spark.read.parquet(f"{path}/{found[-1]}") if found else None


def upsert_latest(path: str, keys: list[str], version: str):
    """A foreachBatch function that keeps the newest row of each key as a snapshot at path/<batch number>.

    The snapshot before is looked up on storage, so a stream that starts again goes on from it, and a
    batch that comes again writes the same snapshot again.
    """
    from agora_spark.operators.places import keyed_latest

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [n for n in snapshots(spark, path) if n < number]
        base = spark.read.parquet(f"{path}/{before[-1]}") if before else batch.limit(0)
        keyed_latest(base, batch, keys, version).write.mode("overwrite").parquet(f"{path}/{number}")

    return merge
