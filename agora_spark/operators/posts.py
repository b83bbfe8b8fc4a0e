"""Posts, photos and reviews as crawls bring them: cursors, caps, buckets, corpora and selections. The time is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora_spark.functions.dates import micros

DAY = 86_400_000_000
#: The days that a unit of a relative lookback counts.
UNIT_DAYS = {"day": 1, "month": 30, "year": 365}


def lookback_days(text: Column) -> Column:
    """The days of a lookback such as '3 months'; null for anything else."""
    form = r"(?i)^\s*(\d+)\s*(day|month|year)s?\s*$"
    unit = F.lower(F.regexp_extract(text, form, 2))
    days = F.coalesce(*(F.when(unit == u, d) for u, d in UNIT_DAYS.items()))
    return F.when(text.rlike(form), F.regexp_extract(text, form, 1).cast("long") * days)


def cutoff(cursor: Column, overlap_hours: float, lookback: Column, now: Column) -> Column:
    """Where a stream's fetch begins: the cursor less an overlap, else the lookback before now; null if that cannot be told."""
    before = lambda at, us: F.timestamp_micros(micros(at) - us)
    return F.when(cursor.isNotNull(), before(cursor, F.lit(int(overlap_hours * 3_600_000_000)))).otherwise(before(now, lookback_days(lookback) * DAY))


def kept_posts(posts: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """posts (key, published, pinned) with kept: only pinned posts that are older than their stream's cutoff (key, cutoff) go; an unknown time or cutoff keeps."""
    gone = F.col("pinned") & (F.col("published") < F.col("cutoff"))
    return posts.join(bounds.select(key, "cutoff"), key, "left").withColumn("kept", ~F.coalesce(gone, F.lit(False))).drop("cutoff")


def advanced(targets: DataFrame, posts: DataFrame, key: str) -> DataFrame:
    """targets (key, cursor, ok) with the cursor of the newest kept post; a run that failed or kept nothing leaves it, and it never goes back."""
    newest = posts.where("kept").groupBy(key).agg(F.max("published").alias("newest"))
    return targets.join(newest, key, "left").withColumn("cursor", F.when(F.col("ok"), F.greatest("cursor", "newest")).otherwise(F.col("cursor"))).drop("newest")


def first_set(*values: Column) -> Column:
    """The first value that is neither null nor 0."""
    return F.coalesce(*(F.nullif(v, F.lit(0)) for v in values))


def newest_run(runs: DataFrame, keys: list[str], run: str = "run") -> DataFrame:
    """The rows of each key's last run; runs sort as text."""
    last = runs.groupBy(*keys).agg(F.max(run).alias("_last"))
    return runs.join(last, keys).where(F.col(run) == F.col("_last")).drop("_last")


def post_buckets(photos: DataFrame, floor: float = 0.0) -> DataFrame:
    """One row for each shortcode of photo entries (shortcode, run, at, photo_key, caption, category, confidence).

    Base fields come from the first entry by (run, at); the flyer is that of the highest confidence, of
    equal ones the first, where none counts as 0; run is the latest. Entries without a shortcode go.
    """
    order = F.struct("run", "at", "photo_key")
    flyer = F.col("category") == "flyer"
    sure = F.coalesce("confidence", F.lit(0.0))
    grouped = photos.where("shortcode IS NOT NULL AND shortcode <> ''").groupBy("shortcode").agg(
        F.min_by("caption", order).alias("caption"), F.min_by("photo_key", order).alias("any_key"), F.max("run").alias("run"), F.count("*").alias("photos"),
        F.min(F.when(flyer, F.struct((-sure).alias("minus"), order.alias("order"), F.col("photo_key"), F.col("confidence")))).alias("f"),
    )
    return grouped.select("shortcode", "caption", "any_key", "run", "photos", F.col("f.photo_key").alias("flyer_key"), F.col("f.confidence").alias("flyer_confidence"))


def qualifies(flyer_key: Column, confidence: Column, markers: Column, floor: float = 0.5) -> Column:
    """Why a post is worth a look: flyer, caption, or null."""
    return F.when(flyer_key.isNotNull() & (F.coalesce(confidence, F.lit(0.0)) >= floor), "flyer").when(F.size(markers) > 0, "caption")


def discovered(batch: DataFrame) -> DataFrame:
    """The rows of a batch (place, venue_id, name) that are new, taken in order of place: neither their id nor their name belongs to a row taken before.

    A row without id and name goes; one that goes reserves neither id nor name. Ids and names that rows
    share make components; each is gone through in order, and what is kept there are the ids and names
    taken.
    """
    from agora_spark.operators.graph import connected, in_order

    id_, name = F.nullif(F.col("venue_id"), F.lit("")), F.nullif(F.col("name"), F.lit(""))
    rows = batch.select("place", F.concat(F.lit("i"), id_).alias("_id"), F.concat(F.lit("n"), name).alias("_name")).where("_id IS NOT NULL OR _name IS NOT NULL")
    parts = connected(rows.where("_id IS NOT NULL AND _name IS NOT NULL").select(F.col("_id").alias("a"), F.col("_name").alias("b")))
    key = F.coalesce("_id", "_name")
    placed = rows.join(parts, key == F.col("node"), "left").select(F.coalesce("component", key).alias("component"), "place", "_id", "_name")

    def take(found):
        taken = set()
        for row in found:
            own = {x for x in (row["_id"], row["_name"]) if x is not None}
            if not own & taken:
                taken |= own
                yield {"place": row["place"]}

    won = in_order(placed, "component", ["place"], take, f"place {dict(batch.dtypes)['place']}")
    return batch.join(won, "place", "left_semi")


def split_budget(points: DataFrame, budget: int, override: int = 0) -> DataFrame:
    """points (point, place, current, most) with take: in order of place, each takes its headroom, at most the override (if positive), until the budget is used up. A negative budget has no end.

    Points are few, a table of settings.
    """
    room = F.greatest(F.col("most") - F.col("current"), F.lit(0))
    want = F.least(room, F.lit(override)) if override > 0 else room
    before = F.coalesce(F.sum(want).over(Window.partitionBy().orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return points.withColumn("take", want if budget < 0 else F.greatest(F.least(want, F.lit(budget) - before), F.lit(0)))


def review_corpus(stored: DataFrame, fetched: DataFrame, now: Column, days: int, cap: int) -> DataFrame:
    """(venue_id, kept, oldest, newest, truncated) of both tables (venue_id, review_id, author, published, text) together.

    Reviews without text and those older than the window go; one of each (author, time, text) stays, the
    stored one first; of those the newest `cap` stay (the cap is the corpus' own limit), undated last.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(fetched.withColumn("_new", F.lit(1)))
    fresh = F.col("published").isNull() | (micros(now) - micros(F.col("published")) <= days * DAY)
    rows = both.where((F.trim(F.coalesce("text", F.lit(""))) != "") & fresh)
    once = rows.groupBy("venue_id", "author", "published", F.md5("text").alias("h")).agg(F.min(F.struct("_new", "review_id")).alias("m"))
    w = Window.partitionBy("venue_id")
    ranked = once.withColumns({"place": F.row_number().over(w.orderBy(F.desc_nulls_last("published"), "m")), "n": F.count("*").over(w)})
    return ranked.where(F.col("place") <= cap).groupBy("venue_id").agg(F.count("*").alias("kept"), F.min("published").alias("oldest"), F.max("published").alias("newest"), (F.max("n") > cap).alias("truncated"))


def fetch_since(newest: Column, now: Column, days: int) -> Column:
    """The later of the window's edge and the newest stored review."""
    return F.greatest(F.timestamp_micros(micros(now) - days * DAY), newest.cast("timestamp"))


def tier_candidates(profiles: DataFrame, tiers: list[str], most: int) -> DataFrame:
    """(venue_id, place) of the first `most` venues (the run's size) of some tiers, in order of their ids."""
    chosen = profiles.where(F.col("tier").isin(tiers)).select("venue_id").distinct().orderBy("venue_id").limit(most)
    return chosen.withColumn("place", F.row_number().over(Window.orderBy("venue_id")))  # no more rows than a run takes


def all_labels(profile: Column, categories: list[str]) -> Column:
    """map<category, labels> of a profile's JSON; a category that is missing or has no labels has an empty list."""
    kind = "struct<" + ", ".join(f"`{c}`: struct<labels: array<string>>" for c in categories) + ">"
    read = F.from_json(profile, kind)
    none = F.array().cast("array<string>")
    return F.create_map(*(x for c in categories for x in (F.lit(c), F.coalesce(read[c]["labels"], none))))


def target_venues(venues: DataFrame, profiles: DataFrame, evidence: DataFrame, allowed: list[str], labels: list[str], least: int, cap: int) -> DataFrame:
    """(venue_id, reason, matches) of the venues to look at for events.

    The category gate lets through allowed categories and, of others, those whose profile (venue_id,
    labels) has one of the labels; then the evidence gate asks for at least `least` matching posts
    (venue_id, matches). The most urgent `cap` of those that pass both are taken (the cap is the run's
    size): the limit follows the filters.
    """
    promoted = F.array_intersect(F.coalesce("labels", F.array().cast("array<string>")), F.lit(labels))
    reason = F.when(F.col("category").isin(allowed), "category").when(F.size(promoted) > 0, F.concat(F.lit("label:"), F.get(promoted, F.lit(0))))
    rows = venues.join(profiles, "venue_id", "left").withColumn("reason", reason).where("reason IS NOT NULL")
    rows = rows.join(evidence.where(F.col("matches") >= least), "venue_id")
    return rows.orderBy("priority", F.desc_nulls_last("reviews"), "venue_id").limit(cap).select("venue_id", "reason", "matches")


def profile_photo_candidates(venues: DataFrame, photos: DataFrame, attempts: DataFrame, now: Column, days: int) -> DataFrame:
    """venues (venue_id, handle) with a handle that need a photo: none stored that is valid for the handle (whatever its age), and no failed attempt with this handle within the days.

    photos: (venue_id, handle, deleted); attempts: (venue_id, handle, failed, at).
    """
    same = lambda rows: rows.select("venue_id", F.lower("handle").alias("handle")).distinct()
    wanted = venues.where("handle IS NOT NULL").withColumn("handle", F.lower("handle"))
    current = same(photos.where("NOT deleted"))
    recent = same(attempts.where("failed").where(micros(F.col("at")) >= micros(now) - days * DAY))
    return wanted.join(current, ["venue_id", "handle"], "left_anti").join(recent, ["venue_id", "handle"], "left_anti")


def remaining_ttl(stored: Column, now: Column, full_seconds: int) -> Column:
    """The seconds that an entry may still be served; null once they are over."""
    left = F.lit(full_seconds) - F.floor((micros(now) - micros(stored)) / 1_000_000)
    return F.when(left > 0, left)
