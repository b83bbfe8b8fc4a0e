"""Likes, sessions and the monthly ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora_spark.functions.dates import local_day
from agora_spark.operators.places import ranked


def likes(events: DataFrame) -> DataFrame:
    """One like per user, venue and local day: its first event."""
    rows = events.where("event_type = 'click'").withColumn("day", local_day(F.col("ts")))
    return rows.groupBy("user_id", "venue_id", "day").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("user_id", "venue_id", "day", F.col("f.event_id").alias("event_id"))


def activity(events: DataFrame, as_of: str) -> DataFrame:
    """Distinct users in all, and in the 1, 7 and 30 local days that end with as_of's."""
    day = local_day(F.col("ts"))
    today = local_day(F.lit(as_of).cast("timestamp"))
    since = lambda n: F.count_distinct(F.when((day <= today) & (F.datediff(today, day) < n), F.col("user_id")))
    return events.agg(F.count_distinct("user_id").alias("total"), since(1).alias("d1"), since(7).alias("d7"), since(30).alias("d30"))


def ledger(events: DataFrame, quota: int) -> DataFrame:
    """(month, venue_id, place, within): venues by their first touch in a month; those up to the quota are within it."""
    touch = events.groupBy(F.date_trunc("month", F.from_utc_timestamp("ts", "America/Recife")).cast("date").alias("month"), "venue_id").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return ranked(touch, ["month"], F.col("first"), F.col("venue_id")).select("month", "venue_id", F.col("place").cast("int").alias("place"), (F.col("place") <= quota).alias("within"))


def hot_sessions(likes_: DataFrame, hours: int = 6) -> DataFrame:
    """(venue_id, started, ended, likes): spans that every like prolongs by so many hours."""
    return likes_.groupBy("venue_id", F.session_window("ts", f"{hours} hours").alias("s")).agg(F.count("*").alias("likes")).select("venue_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "likes")
