"""The read model: all families of a venue in one snapshot, and the feed of changes from one cycle to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora_spark.operators.posts import remaining_ttl
from agora_spark.streaming import snapshots

# The families of the read model. Weekly forecasts have a day, 0 to 6; of the others there is one entry a venue.
FAMILIES = (
    "venue", "google_places.vibe_attributes", "google_places.opening_hours", "google_places.reviews", "google_places.photos", "instagram.handle", "instagram.posts", "instagram.profile_photo", "venues.menu_photos", "venues.menu_data", "venues.vibe_profile", "venues.reviews_deep",
    "besttime.weekly_forecast", "besttime.live_forecast",
)
WEEKLY, PHOTOS = "besttime.weekly_forecast", "google_places.photos"
KEY = ["venue_id", "family", "day"]


def entries(tables: dict[str, DataFrame], now: Column, photo_seconds: int) -> DataFrame:
    """(venue_id, family, day, payload, ttl, updated_at) of all families' tables (venue_id, day, payload, updated_at, deleted).

    Soft deleted rows are left out. Photos count their time down: ttl is what is left of it, and photos
    whose time is over are left out. day is -1 in families without days.
    """
    every = None
    for family, table in tables.items():
        rows = table.where("NOT deleted").select("venue_id", F.lit(family).alias("family"), (F.col("day") if family == WEEKLY else F.lit(-1)).cast("int").alias("day"), F.col("payload").cast("string").alias("payload"), "updated_at")
        left = F.when(F.col("updated_at").isNull(), photo_seconds).otherwise(remaining_ttl(F.col("updated_at"), now, photo_seconds)) if family == PHOTOS else F.lit(None)
        rows = rows.withColumn("ttl", left.cast("long"))
        if family == PHOTOS:
            rows = rows.where("ttl IS NOT NULL")
        every = rows if every is None else every.unionByName(rows)
    return every


def served(rows: DataFrame, servable: DataFrame) -> DataFrame:
    """The newest entry of each key of rows (entries()), of servable venues (venue_id) only; ties: the larger payload.

    The servable ids travel with the entries, and all are dealt by venue once: what follows needs no
    further exchange.
    """
    tagged = rows.withColumn("_serve", F.lit(False)).unionByName(servable.select("venue_id").withColumn("_serve", F.lit(True)), allowMissingColumns=True).repartition("venue_id")
    newest = tagged.groupBy("venue_id", "family", "day").agg(F.max("_serve").alias("_serve"), F.max(F.struct("updated_at", "payload", "ttl")).alias("_r"))
    listed = newest.groupBy("venue_id").agg(F.max("_serve").alias("_serve"), F.collect_list(F.struct("family", "day", F.col("_r.payload").alias("payload"), F.col("_r.ttl").alias("ttl"))).alias("rows")).where("_serve")
    return listed.select("venue_id", F.filter("rows", lambda r: r["family"].isNotNull()).alias("rows"))


def snapshot(rows: DataFrame, servable: DataFrame) -> DataFrame:
    """One row for each servable venue: a column of the payload for each family (dots as _), weekly as seven, ttl of the photos, and the number of families there are."""
    listed = served(rows, servable)
    of = lambda family, field="payload": F.get(F.filter("rows", lambda r: r["family"] == family), F.lit(0))[field]
    weekly = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.get(F.filter("rows", lambda r: (r["family"] == WEEKLY) & (r["day"] == d)), F.lit(0))["payload"])
    columns = [(weekly if f == WEEKLY else of(f)).alias(f.replace(".", "_")) for f in FAMILIES]
    return listed.select("venue_id", *columns, of(PHOTOS, "ttl").alias("photos_ttl"), F.size(F.array_distinct(F.transform("rows", lambda r: r["family"]))).cast("long").alias("families"))


def read_model(rows: DataFrame, servable: DataFrame) -> DataFrame:
    """(venue_id, family, day, payload, digest): the entries that are served, each with a digest of its payload."""
    flat = served(rows, servable).select("venue_id", F.explode("rows").alias("r"))
    return flat.select("venue_id", "r.family", "r.day", "r.payload", F.sha2(F.coalesce("r.payload", F.lit("")), 256).alias("digest"))


def changes(before: DataFrame, after: DataFrame, known: DataFrame) -> DataFrame:
    """(venue_id, family, day, op, payload, digest) from one read_model() to the next; op is insert, update or delete.

    Entries that are no longer there are deleted if their venue is known (venue_id) to the system of
    record; what belongs to none is left alone, for absence there says nothing.
    """
    old = before.select(*KEY, F.col("digest").alias("_was"))
    both = old.join(after.withColumnRenamed("digest", "_now"), KEY, "full").where("_was IS NULL OR _now IS NULL OR _was <> _now")
    op = F.when(F.col("_was").isNull(), "insert").when(F.col("_now").isNull(), "delete").otherwise("update")
    feed = both.select(*KEY, op.alias("op"), "payload", F.col("_now").alias("digest"))
    gone = feed.where("op = 'delete'").join(known.select("venue_id").distinct(), "venue_id", "left_semi")
    return feed.where("op <> 'delete'").unionByName(gone.select(*feed.columns))


def cycle(before: DataFrame, was_servable: DataFrame, after: DataFrame, servable: DataFrame, known: DataFrame) -> DataFrame:
    """changes() from the model of one cycle's entries() and servable ids (venue_id) to that of the next one's.

    No model is made first: entries, ids and known venues travel together and are dealt by venue once,
    and payloads are compared where they meet.
    """
    was, now, row = 0, 1, 2
    marks = [(was_servable, was), (servable, now), (known, row)]
    every = before.select(*KEY, "updated_at", "payload", F.lit(was).alias("_of"))
    every = every.unionByName(after.select(*KEY, "updated_at", "payload", F.lit(now).alias("_of")))
    for ids, mark in marks:
        every = every.unionByName(ids.select("venue_id", F.lit(mark).alias("_mark")), allowMissingColumns=True)
    newest = lambda of: F.max(F.when(F.col("_of") == of, F.struct("updated_at", "payload")))
    met = every.repartition("venue_id").groupBy(*KEY).agg(newest(was).alias("_was"), newest(now).alias("_now"), *(F.max(F.col("_mark") == m).alias(f"_m{m}") for _, m in marks))
    here = {f"_m{m}": F.coalesce(F.max(f"_m{m}").over(Window.partitionBy("venue_id")), F.lit(False)) for _, m in marks}
    both = met.withColumns(here).where("family IS NOT NULL")
    old, new = F.col("_was").isNotNull() & F.col("_m0"), F.col("_now").isNotNull() & F.col("_m1")
    payload = lambda c: F.coalesce(F.col(f"{c}.payload"), F.lit(""))
    op = F.when(new & ~old, "insert").when(old & ~new & F.col("_m2"), "delete").when(old & new & (payload("_was") != payload("_now")), "update")
    digest = F.sha2(payload("_now"), 256)
    return both.select(*KEY, op.alias("op"), *(F.when(new, c).alias(name) for c, name in ((F.col("_now.payload"), "payload"), (digest, "digest")))).where("op IS NOT NULL")


def applied(before: DataFrame, feed: DataFrame) -> DataFrame:
    """A read model after a feed of changes()."""
    kept = before.join(feed.select(*KEY), KEY, "left_anti")
    return kept.select(*KEY, "payload", "digest").unionByName(feed.where("op <> 'delete'").select(*KEY, "payload", "digest"))


MODEL = "venue_id string, family string, day int, payload string, digest string"


def current(spark: SparkSession, path: str, below: int | None = None) -> DataFrame:
    """The published read model at path: the newest whole one and the feeds since; with below, as it was before that cycle."""
    under = lambda kind: [n for n in snapshots(spark, f"{path}/{kind}") if below is None or n < below]
    whole, feeds = under("whole"), under("feed")
    base = whole[-1] if whole else -1
    model = spark.read.schema(MODEL).parquet(f"{path}/whole/{base}") if whole else spark.createDataFrame([], MODEL)
    since = [n for n in feeds if n > base]
    if not since:
        return model
    every = None
    for n in since:
        feed = spark.read.schema(MODEL + ", op string").parquet(f"{path}/feed/{n}").withColumn("_n", F.lit(n))
        every = feed if every is None else every.unionByName(feed)
    last = every.groupBy(*KEY).agg(F.max_by(F.struct("op", "payload", "digest"), "_n").alias("l")).select(*KEY, "l.op", "l.payload", "l.digest")
    return applied(model, last)


def publish(path: str, number: int, after: DataFrame, known: DataFrame, whole_every: int = 16) -> DataFrame:
    """Write cycle `number`: the changes from the model before it to after, and now and then the whole model, so that few feeds are read.

    A cycle that comes again looks at what was before it, and writes the same again. Returns the feed.
    """
    spark = after.sparkSession
    before = current(spark, path, number)
    changes(before, after, known).write.mode("overwrite").parquet(f"{path}/feed/{number}")
    feed = spark.read.schema(MODEL + ", op string").parquet(f"{path}/feed/{number}")
    if number % whole_every == 0:
        applied(before, feed).write.mode("overwrite").parquet(f"{path}/whole/{number}")
    return feed
