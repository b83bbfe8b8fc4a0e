"""The life of events over micro-batches of posts: read, reconcile, collapse, absorb, suggest, in one run with several outputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora_spark.operators import happenings
from agora_spark.operators import merging as M
from agora_spark.operators.graph import drop, held
from agora_spark.streaming import snapshots

EVENT = "event_id long, post long, venue long, handle string, starts_at timestamp_ntz, title string, status string, price string, place string, last_seen timestamp_ntz, reason string, edited array<string>, kind string"
COLUMNS = [c.split()[0] for c in EVENT.split(", ")]
#: What a post says of an event; what is merged when events turn out to be one.
READ, FIELDS = ["title", "starts_at", "price", "place", "reason"], ["price", "place"]
GONE, PAIR = "event_id long, into long, how string", "low long, high long"
SHOW, DISH = ["venue", "day", "named"], ["venue", "named"]


@dataclass
class Step:
    """The tables after a batch: events, what went where in it (GONE), and suggestions that wait (PAIR)."""

    events: DataFrame
    gone: DataFrame
    pending: DataFrame


def reconciled(events: DataFrame, prepared: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, gone, touched ids) once what posts say now has met what they said before.

    An unprotected row takes the new reading, a confirmed one what protected_fields() lets through.
    Readings that match nothing become pending events; rows that their post no longer tells are
    superseded, but for confirmed ones.
    """
    key = M.source_key(F.col("title"), F.col("starts_at"))
    told = prepared.select("post").distinct()
    of_posts = events.join(told, "post", "left_semi").hint("merge")
    outcome = held(M.reconcile(of_posts, prepared))
    old = of_posts.withColumn("_key", key).select("post", "_key", "event_id").join(outcome.select("event_id", "outcome"), "event_id")
    new = prepared.withColumn("_key", key)
    first = new.groupBy("post", "_key").agg(F.min("event_id").alias("_new"))
    kept = old.where("outcome = 'updated'").join(first, ["post", "_key"]).select("event_id", "_new")
    lone = first.join(old.select("post", "_key"), ["post", "_key"], "left_anti").hint("merge")
    paired = old.where("outcome = 'paired'").select("event_id", "post").join(lone, "post").select("event_id", "_new")
    matched = kept.unionByName(paired)
    readings = new.select(F.col("event_id").alias("_new"), F.col("last_seen").alias("new_seen"), *(F.col(c).alias(f"new_{c}") for c in READ))
    both = held(events.join(matched, "event_id").join(readings, "_new"))
    guarded = M.is_protected(F.col("status"))
    sure = both.where(guarded).select("event_id", "edited", *(F.col(c).alias(f"old_{c}") for c in READ), *(f"new_{c}" for c in READ))
    allowed = M.protected_fields(sure.withColumn("edited", F.coalesce("edited", F.lit(READ))), READ)
    confirmed = both.where(guarded).drop(*READ).join(allowed.withColumn("reason", F.when(F.col("diverges"), M.DIVERGES).otherwise(F.col("reason"))).drop("diverges"), "event_id")
    free = both.where(~guarded).drop(*READ).withColumnsRenamed({f"new_{c}": c for c in READ})
    changed = [x.withColumn("last_seen", F.greatest("last_seen", "new_seen")).select(*COLUMNS) for x in (confirmed, free)]
    made = outcome.where("outcome = 'inserted'").select("event_id").join(prepared, "event_id").withColumn("status", F.lit("pending")).withColumn("edited", F.lit(None).cast("array<string>")).select(*COLUMNS)
    dropped = outcome.where("outcome = 'superseded'").select("event_id", F.col("successor").alias("into"), F.lit("superseded").alias("how"))
    rest = events.join(dropped.select("event_id").unionByName(matched.select("event_id")), "event_id", "left_anti").select(*COLUMNS)
    after = held(rest.unionByName(changed[0]).unionByName(changed[1]).unionByName(made))
    return after, dropped, matched.select("event_id").unionByName(made.select("event_id"))


def collapsed(events: DataFrame, touched: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(events, gone) once rows of one identity are one: shows by venue, day and title, dishes by venue and title. Only groups that the batch touched are looked at."""
    dish = kind == "menu"
    keys = DISH if dish else SHOW
    rows = M.identified(events.where("kind = 'menu'" if dish else "kind <> 'menu' OR kind IS NULL"), *(["venue"] if dish else ["venue", "day"]))
    groups = rows.join(touched, "event_id", "left_semi").select(*keys).distinct()
    rows = rows.join(groups, keys, "left_semi").hint("merge")
    merged = held(M.merged_fields(rows, keys, FIELDS).select("canonical", *FIELDS, "reason"))
    heads = M.canonical_of(rows, keys).where("n > 1 AND canonical IS NOT NULL")
    gone = held(rows.join(heads, keys).where("event_id <> canonical").select("event_id", F.col("canonical").alias("into"), F.lit("identity").alias("how")))
    seen = gone.join(events.select("event_id", "last_seen"), "event_id").groupBy(F.col("into").alias("canonical")).agg(F.max("last_seen").alias("seen"))
    head = events.drop(*FIELDS, "reason").join(merged.join(seen, "canonical"), F.col("event_id") == F.col("canonical")).withColumn("last_seen", F.greatest("last_seen", "seen")).select(*COLUMNS)
    rest = events.join(gone.select("event_id").unionByName(merged.select(F.col("canonical").alias("event_id"))), "event_id", "left_anti")
    return held(rest.unionByName(head)), gone


def absorbed(events: DataFrame, touched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, gone) once rows without a venue have gone into the row of their account, day and title; that row takes over their reasons."""
    keys = ["handle", "day", "named"]
    groups = M.identified(events, "handle", "day").join(touched, "event_id", "left_semi").select(*keys).distinct()
    near = M.identified(events, "handle", "day").join(groups, keys, "left_semi").select(*COLUMNS).hint("merge")
    found = held(M.absorbed_by_handle(near))
    reason = found.groupBy(F.col("into").alias("event_id")).agg(F.max_by("reason", "event_id").alias("_reason"), F.lit(True).alias("_head"))
    after = events.join(found.select("event_id"), "event_id", "left_anti").join(reason, "event_id", "left").withColumn("reason", F.when(F.col("_head"), F.col("_reason")).otherwise(F.col("reason"))).select(*COLUMNS)
    return held(after), found.select("event_id", "into", F.lit("handle").alias("how"))


def alike(events: DataFrame, touched: DataFrame, pending: DataFrame, generic: list[str], stop: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, gone, suggestions) once the events of touched venues are compared by titles: sure pairs' components go into one row, others wait for a person."""
    venues = events.join(touched, "event_id", "left_semi").where("venue IS NOT NULL").select("venue").distinct()
    near = events.where("kind <> 'menu' OR kind IS NULL").join(venues, "venue", "left_semi").hint("merge")
    pairs = held(happenings.judged_pairs(near.select("event_id", "venue", "starts_at", "title"), generic, stop))
    gone = held(M.absorbed_components(pairs.where("band = 'auto'").select("event_id", "other_event_id"), near).withColumn("how", F.lit("title")))
    after = held(events.join(gone, "event_id", "left_anti"))
    there = lambda c: after.select(F.col("event_id").alias(c))
    open_ = pairs.where("band = 'suggest'").select(F.col("event_id").alias("a"), F.col("other_event_id").alias("b")).join(there("a"), "a", "left_semi").join(there("b"), "b", "left_semi")
    added = M.new_suggestions(open_, pending.select(F.col("low").alias("a"), F.col("high").alias("b")))
    left = pending.join(there("low"), "low", "left_semi").join(there("high"), "high", "left_semi").select("low", "high")
    return after, gone, left.unionByName(added)


def step(events: DataFrame, pending: DataFrame, prepared: DataFrame, generic: list[str], stop: list[str]) -> Step:
    """One batch: reconcile, collapse, absorb and suggest, each over the rows that the one before has written.

    prepared: the columns of EVENT but status and edited, with the id that a new event is to have. Only
    groups and venues that the batch touches are compared. A confirmed row never goes.
    """
    events, pending, prepared = events.hint("merge"), pending.hint("merge"), held(prepared)  # they grow: none is broadcast
    one, superseded, ids = reconciled(events, prepared)
    touched = held(ids.distinct())
    two, dishes = collapsed(one, touched, "menu")
    three, shows = collapsed(two, touched, "event")
    four, handles = absorbed(three, touched)
    five, titles, waiting = alike(four, touched, pending, generic, stop)
    drop(two, three, four)
    parts = [x.select("event_id", "into", "how") for x in (dishes, shows, handles, titles)]
    gone = superseded
    for part in parts:
        gone = gone.unionByName(part)
    return Step(five, gone, waiting)


def read(spark: SparkSession, path: str, table: str, schema: str, below: int | None = None) -> DataFrame:
    """The newest version of a table under path, or of those before a batch; empty if there is none."""
    found = [n for n in snapshots(spark, f"{path}/{table}") if below is None or n < below]
    return spark.read.schema(schema).parquet(f"{path}/{table}/{found[-1]}") if found else spark.createDataFrame([], schema)


def lifecycle(path: str, generic: list[str], stop: list[str]):
    """A foreachBatch function that keeps events, pending and gone under path, a version for each batch.

    A batch looks at the versions before its own number, so one that comes again gives the same tables.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        after = step(read(spark, path, "events", EVENT, number), read(spark, path, "pending", PAIR, number), batch, generic, stop)
        for name, table in (("gone", after.gone), ("pending", after.pending), ("events", after.events)):
            table.write.mode("overwrite").parquet(f"{path}/{name}/{number}")

    return run
