"""Named queries on the read model: all families in one snapshot, and the feed between two cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora_spark.operators import eligibility as E
from agora_spark.operators import projection as P
from agora_spark.plans.catalog import CIRCLES, DECIDED, INSIDE, RULES, _good, _weekly, query
from agora_spark.sources import standins as S

TTL = 100 * 3600
#: The families that have a table of their own only here; their payloads are numbers.
MADE = tuple(f for f in P.FAMILIES if f not in ("venue", P.WEEKLY, "besttime.live_forecast", "google_places.reviews"))


def _entry(i: str, was: bool) -> str:
    """Payload of family i of venue k; was: as it stood a cycle before."""
    return f"((k * ({i} + 3) % 1000" + (f" + CASE WHEN (k + {i}) % 4 = 0 THEN 1 ELSE 0 END" if was else "") + ")::VARCHAR)"


def _entries_sql(name: str, was: bool) -> str:
    made = ", ".join(f"({i}, '{f}')" for i, f in enumerate(MADE))
    some, hours = ("% 7 <> 0" if was else "% 5 <> 0"), f"((k * 11 + i) % {90 if was else 200})"
    return f"""{name} AS (SELECT v.venue_id, family, -1 AS day, {_entry('i', was)} AS payload, CASE WHEN family = '{P.PHOTOS}' THEN {TTL} - {hours} * 3600 END AS ttl FROM venue v, (VALUES {made}) f(i, family) WHERE (k + i) {some} AND (k * (i + 1)) % 13 <> 0 AND (family <> '{P.PHOTOS}' OR {hours} * 3600 < {TTL})
UNION ALL SELECT venue_id, 'venue', -1, name, NULL FROM venue UNION ALL SELECT venue_id, '{P.WEEKLY}', d, array_to_string(grid, ','), NULL FROM weekly{' WHERE k % 3 <> 0' if was else ''} UNION ALL SELECT venue_id, 'besttime.live_forecast', -1, busyness::VARCHAR, NULL FROM live{' WHERE busyness > 20' if was else ''}
UNION ALL SELECT venue_id, 'google_places.reviews', -1, reviews::VARCHAR, NULL FROM rating)"""


WEEK = "weekly AS (SELECT venue_id, k, d, list_transform(range(24), lambda h: (k * 7 + d * 3 + h * 5) % 101) AS grid FROM venue, (SELECT unnest(range(7)) AS d) WHERE (k + d) % 6 <> 0)"
SERVED = f"{DECIDED}, served AS (SELECT venue_id, k FROM decided WHERE lifecycle = 'active' AND (why IS NULL OR sure = 'low') AND {INSIDE})"


def _tables(spark: SparkSession, sf_dir: str, was: bool) -> dict[str, DataFrame]:
    k, at = F.col("k"), F.lit(S.AS_OF).cast("timestamp")
    venue = S.venue(spark, sf_dir)
    none = {"day": F.lit(None).cast("int"), "updated_at": at, "deleted": F.lit(False)}
    out = {"venue": venue.select("venue_id", F.col("name").alias("payload")).withColumns(none)}
    for i, family in enumerate(MADE):
        payload = k * (i + 3) % 1000 + (F.when((k + i) % 4 == 0, 1).otherwise(0) if was else 0)
        rows = venue.where((k + i) % (7 if was else 5) != 0)
        hours = ((k * 11 + i) % (90 if was else 200)).cast("int")
        out[family] = rows.select("venue_id", payload.cast("string").alias("payload"), none["day"].alias("day"), (at - F.make_dt_interval(hours=hours)).alias("updated_at"), ((k * (i + 1)) % 13 == 0).alias("deleted"))
    weekly = _weekly(spark, sf_dir)
    live = S.live(spark, sf_dir)
    out[P.WEEKLY] = (weekly.where("k % 3 <> 0") if was else weekly).select("venue_id", F.col("d").alias("day"), F.array_join("grid", ",").alias("payload")).withColumns({c: v for c, v in none.items() if c != "day"})
    out["besttime.live_forecast"] = (live.where("busyness > 20") if was else live).select("venue_id", F.col("busyness").cast("string").alias("payload")).withColumns(none)
    out["google_places.reviews"] = S.rating(spark, sf_dir).select("venue_id", F.col("reviews").cast("string").alias("payload")).withColumns(none)
    return out


def _model(spark: SparkSession, sf_dir: str, was: bool = False) -> tuple[DataFrame, DataFrame]:
    """The entries of all families, and the ids that are served."""
    served = E.servable(S.venue(spark, sf_dir), RULES, _good(), CIRCLES)
    return P.entries(_tables(spark, sf_dir, was), F.lit(S.AS_OF).cast("timestamp"), TTL), served.where("k % 11 <> 0" if was else "k % 10 <> 0").select("venue_id")


def _column(family: str) -> str:
    value = f"max(payload) FILTER (family = '{family}')" if family != P.WEEKLY else "[" + ", ".join(f"max(payload) FILTER (family = '{P.WEEKLY}' AND day = {d})" for d in range(7)) + "]"
    return f"md5(coalesce(array_to_string(list_transform({value}, lambda x: coalesce(x, '-')), ';'), '')) AS {family.replace('.', '_')}" if family == P.WEEKLY else f"{value} AS {family.replace('.', '_')}"


@query(S.sql("venue", "rating", "live") + f", {WEEK}, {_entries_sql('entry', False)}, {SERVED} SELECT venue_id, {', '.join(_column(f) for f in P.FAMILIES)}, max(ttl) AS photos_ttl, count(DISTINCT family) AS families FROM entry JOIN served USING (venue_id) WHERE k % 10 <> 0 GROUP BY venue_id")
def family_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fourteen families of every servable venue, by one exchange."""
    week = P.WEEKLY.replace(".", "_")
    joined = F.md5(F.array_join(F.transform(week, lambda x: F.coalesce(x, F.lit("-"))), ";"))
    return P.snapshot(*_model(spark, sf_dir)).withColumn(week, joined)


@query(S.sql("venue", "rating", "live") + f""", {WEEK}, {_entries_sql('entry', False)}, {_entries_sql('older', True)}, {SERVED},
after AS (SELECT venue_id, family, day, payload FROM entry JOIN served USING (venue_id) WHERE k % 10 <> 0), before AS (SELECT venue_id, family, day, payload FROM older JOIN served USING (venue_id) WHERE k % 11 <> 0 UNION ALL SELECT 'gone' || venue_id, family, day, payload FROM older JOIN served USING (venue_id) WHERE k % 50 = 1)
SELECT coalesce(a.venue_id, b.venue_id) AS venue_id, coalesce(a.family, b.family) AS family, coalesce(a.day, b.day) AS day, CASE WHEN b.venue_id IS NULL THEN 'insert' WHEN a.venue_id IS NULL THEN 'delete' ELSE 'update' END AS op, a.payload
FROM after a FULL JOIN before b ON a.venue_id = b.venue_id AND a.family = b.family AND a.day = b.day WHERE (b.venue_id IS NULL OR a.venue_id IS NULL OR coalesce(a.payload, '') <> coalesce(b.payload, '')) AND (a.venue_id IS NOT NULL OR b.venue_id IN (SELECT venue_id FROM venue))""")
def projection_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes in the read model from one cycle to the next; entries of venues without a row are left alone."""
    old, now = (P.entries(_tables(spark, sf_dir, was), F.lit(S.AS_OF).cast("timestamp"), TTL) for was in (True, False))
    venue, served = S.venue(spark, sf_dir), E.servable(S.venue(spark, sf_dir), RULES, _good(), CIRCLES).select("venue_id", "k")
    gone = F.concat(F.lit("gone"), "venue_id")  # these have no row
    k = F.substring("venue_id", 2, 20).cast("long")
    names = lambda k, itself: F.explode(F.filter(F.array(F.when(itself, F.col("venue_id")), F.when(k % 50 == 1, gone)), lambda x: x.isNotNull()))
    old = old.withColumn("venue_id", names(k, F.lit(True)))
    was = served.select(names(F.col("k"), F.col("k") % 11 != 0).alias("venue_id"))
    return P.cycle(old, was, now, served.where("k % 10 <> 0"), venue).select(*P.KEY, "op", "payload")


def _batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events that are stored, and what posts say now; about eight posts of twenty rows share a venue."""
    from agora_spark.streaming import lifecycle as L

    rows = S.announcement(spark, sf_dir)
    k = F.col("event_id")
    venues = rows.agg(F.greatest(F.floor(F.max("post") / 8), F.lit(1)).alias("venues"))
    rows = rows.crossJoin(F.broadcast(venues)).withColumn("venue", F.when(k % 9 != 0, F.col("post") % F.col("venues"))).withColumn("handle", F.when(k % 17 != 0, F.concat(F.lit("h"), F.col("post") % F.col("venues"))))
    rows = rows.withColumn("last_seen", F.col("last_seen").cast("timestamp_ntz")).withColumn("edited", F.col("edited").cast("array<string>"))
    stored = rows.where("event_id % 3 <> 2").select(*(F.col(c).cast(t) for c, t in (x.split(" ", 1) for x in L.EVENT.split(", "))))
    told = rows.where("event_id % 5 <> 0").withColumn("event_id", k + 1_000_000_000).withColumn("title", F.when(k % 7 == 0, F.concat("title", F.lit(" Extra"))).otherwise(F.col("title")))
    return stored, told.select(*(F.col(c).cast(t) for c, t in (x.split(" ", 1) for x in L.EVENT.split(", ")) if c not in ("status", "edited")))


@query()
def event_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fate of every stored and every newly told event after one batch: live, or where it went and how."""
    from agora_spark.plans.catalog import GENERIC, STOP
    from agora_spark.streaming import lifecycle as L

    stored, told = _batches(spark, sf_dir)
    after = L.step(stored, spark.createDataFrame([], L.PAIR), told, GENERIC, STOP)
    live = after.events.select("event_id", F.lit(None).cast("long").alias("into"), F.lit("live").alias("fate"), "title", "price", "place", "reason")
    return live.unionByName(after.gone.select("event_id", "into", F.col("how").alias("fate")), allowMissingColumns=True)
