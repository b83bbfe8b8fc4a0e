"""Events from posts: identity, candidate pairs, sources, review queues and resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora_spark.functions.dates import micros
from agora_spark.functions.sets import in_window
from agora_spark.functions.text import distinctive_tokens, normalize_title

def source_key(title, starts_at):
    """32 hex characters of a hash of normalised title and calendar date."""
    day = F.coalesce(F.date_format(starts_at, "yyyy-MM-dd"), F.lit(""))
    return F.left(F.sha2(F.concat(normalize_title(title), F.lit("|"), day), 256), F.lit(32))


def candidate_pairs(events: DataFrame, hours: int = 8) -> DataFrame:
    """Pairs of a venue's events in the candidate window, the smaller id first.

    A range join: an event's time falls in buckets of half a day, the other side is sent to the two
    buckets around as well, so a venue with many events is not joined with itself at large.
    """
    bucket = F.floor(micros(F.col("starts_at")) / (12 * 3_600_000_000))
    reach = -(-max(hours, 24) // 12)
    a = events.where("starts_at IS NOT NULL").withColumn("bucket", bucket)
    b = a.select(*(F.col(c).alias(f"other_{c}") if c != "venue" else F.col(c) for c in events.columns), F.explode(F.sequence(F.col("bucket") - reach, F.col("bucket") + reach)).alias("bucket"))
    return a.join(b, ["venue", "bucket"]).where((F.col("event_id") < F.col("other_event_id")) & in_window(F.col("starts_at"), F.col("other_starts_at"), hours)).drop("bucket")


def worded(events: DataFrame, generic: list[str], stop: list[str]) -> DataFrame:
    """(event_id, venue, starts_at, words) with the distinctive words of the titles."""
    none = F.lit(None).cast("string")
    return events.select("event_id", "venue", "starts_at", distinctive_tokens(F.col("title"), none, F.array(*map(F.lit, generic)), F.array(*map(F.lit, stop))).alias("words"))


def judged_pairs(events: DataFrame, generic: list[str], stop: list[str], hours: int = 8) -> DataFrame:
    """(venue, event_id, other_event_id, band) of a venue's pairs of one local day or within hours that are not refused, the smaller id first."""
    from agora_spark.operators.runs import token_pairs

    return token_pairs(worded(events, generic, stop), hours)


def with_sources(events: DataFrame, sources: DataFrame) -> DataFrame:
    """Events with their newest source (ties: the larger id, then kind, then handle) and the first and last time they were seen."""
    newest = sources.groupBy("event_id").agg(F.max(F.struct("seen_at", "source_id", "kind", "handle")).alias("s"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    return events.join(newest, "event_id", "left").select(*events.columns, F.col("s.source_id").alias("source_id"), F.col("s.handle").alias("source_handle"), F.col("s.kind").alias("source_kind"), "first_seen", "last_seen")


def hidden(sources: DataFrame) -> DataFrame:
    """event_id of items that promoters alone have announced."""
    return sources.groupBy("event_id").agg(F.bool_and(F.col("kind") == "promoter").alias("alone")).where("alone").select("event_id")


def canonical(events: DataFrame, protected) -> DataFrame:
    """(venue, day, title, n, canonical) of events of one identity: the only protected one, else the smallest id; none if several are protected."""
    guard = F.count_if(protected)
    keys = [F.col("venue"), F.to_date("starts_at").alias("day"), normalize_title(F.col("title")).alias("title")]
    grouped = events.where("starts_at IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), guard.alias("guarded"), F.min("event_id").alias("low"), F.min(F.when(protected, F.col("event_id"))).alias("kept"))
    return grouped.select("venue", "day", "title", "n", F.when(F.col("guarded") == 1, F.col("kept")).when(F.col("guarded") == 0, F.col("low")).alias("canonical"))


def richest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of a key the one with most images, then the smallest place; rows without a key all stay."""
    known = F.col(keys[0]).isNotNull()
    best = rows.where(known).groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), F.struct("n_images", -F.col("line"))).alias("_b"))
    return best.select(*(F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in rows.columns)).unionByName(rows.where(~known))


def sibling_years(dates: DataFrame) -> DataFrame:
    """(post, month, year) that most of a post's dates of a month have; at a tie the one that was stated, else none."""
    n = dates.groupBy("post", "month", "year").agg(F.count("*").alias("n"), F.bool_or(~F.col("inferred")).alias("stated"))
    top = n.groupBy("post", "month").agg(F.max("n").alias("most"))
    best = n.join(top, ["post", "month"]).where("n = most").groupBy("post", "month").agg(F.count("*").alias("tied"), F.min("year").alias("one"), F.count_if("stated").alias("n_stated"), F.min(F.when(F.col("stated"), F.col("year"))).alias("said"))
    return best.select("post", "month", F.when(F.col("tied") == 1, F.col("one")).when(F.col("n_stated") == 1, F.col("said")).alias("year"))


def absorbed(undated: DataFrame, dated: DataFrame, days: int = 14) -> DataFrame:
    """(event_id, into): the nearest dated event of the same handle and title within days of an undated one's post (ties: the smaller id)."""
    j = undated.join(dated.select("handle", "title", F.col("event_id").alias("into"), F.col("starts_at").alias("at")), ["handle", "title"])
    gap = F.abs(micros(F.col("posted")) - micros(F.col("at")))
    return j.where(gap <= days * 86_400_000_000).groupBy("event_id").agg(F.min(F.struct(gap.alias("gap"), "into")).alias("m")).select("event_id", F.col("m.into").alias("into"))


def undated_twins(undated: DataFrame, dated: DataFrame, generic: list[str], stop: list[str], days: int = 14) -> DataFrame:
    """(event_id, into) as absorbed(), of one venue and handle and the same distinctive words, whatever their order, case or marks; titles without such words have no twin.

    Both sides have venue, venue_name, handle and title.
    """
    words = distinctive_tokens(F.col("title"), F.col("venue_name"), F.array(*map(F.lit, generic)), F.array(*map(F.lit, stop)))
    key = lambda rows: rows.withColumn("title", F.concat_ws(" ", words)).where("title <> ''").withColumn("handle", F.struct("venue", "handle"))
    named = F.col("venue").isNotNull() & (F.col("handle") != "")
    return absorbed(key(undated.where(named)), key(dated.where(named)), days)
