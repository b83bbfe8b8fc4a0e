"""More named queries: fences, sources, identities, upserts and their history, paging, dates in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora_spark.functions import dates, told, text
from agora_spark.functions.geo import haversine_km
from agora_spark.operators import eligibility as E
from agora_spark.operators import happenings, places
from agora_spark.plans.catalog import CATEGORY, CIRCLES, CROWD_MAP, GOOGLE_MAP, _km, _unmark, query
from agora_spark.sources import standins as S

CITY = ", city(city, city_lat, city_lng, city_km) AS (VALUES " + ", ".join(f"({i}, {a}, {o}, {km})" for i, (a, o, km) in enumerate(CIRCLES)) + ")"


@query(S.sql("venue") + CITY + f" SELECT venue_id, city FROM venue JOIN city ON {_km('city_lat', 'city_lng', 'lat', 'lng')} <= city_km")
def geo_fence_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which circles a venue lies in; the circles are few, so no join is needed."""
    inside = F.array_compact(F.array(*(F.when(haversine_km(F.lit(a), F.lit(o), F.col("lat"), F.col("lng")) <= km, i) for i, (a, o, km) in enumerate(CIRCLES))))
    return S.venue(spark, sf_dir).select("venue_id", F.explode(inside).alias("city"))


@query(S.sql("venue") + f"SELECT venue_id, {CATEGORY} AS category, coalesce(gtype, lower(btype)) AS type_key, replace(coalesce(gtype, lower(btype)), '#', ' ') AS label FROM venue")
def category_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce("gtype", F.lower("btype"))
    return S.venue(spark, sf_dir).select("venue_id", E.category(F.col("gtype"), F.col("btype"), GOOGLE_MAP, CROWD_MAP).alias("category"), key.alias("type_key"), F.replace(key, F.lit("#"), F.lit(" ")).alias("label"))


@query(S.sql("venue") + ", known(reason) AS (VALUES ('eligibility'), ('closed'), ('manual'), ('merged')) SELECT known.reason, count(k) AS venues FROM known LEFT JOIN venue ON venue.reason = known.reason GROUP BY 1")
def deprecation_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the known reasons, zeros included."""
    known = spark.createDataFrame([("eligibility",), ("closed",), ("manual",), ("merged",)], "reason string")
    n = S.venue(spark, sf_dir).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    return known.join(n, "reason", "left").select("reason", F.coalesce("n", F.lit(0)).alias("venues"))


@query(S.sql("source") + "SELECT event_id, source_id, seen_at, kind FROM source QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seen_at DESC, source_id DESC) = 1")
def primary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest source of each event (ties, which the SQL leaves open: the larger kind), in one aggregate that combines before the shuffle."""
    best = S.post_source(spark, sf_dir).groupBy("event_id").agg(F.max(F.struct("seen_at", "source_id", "kind")).alias("s"))
    return best.select("event_id", "s.source_id", "s.seen_at", "s.kind")


@query(S.sql("source") + "SELECT event_id, min(seen_at) AS first_seen, max(seen_at) AS last_seen, count(*) AS sources FROM source GROUP BY 1")
def seen_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.post_source(spark, sf_dir).groupBy("event_id").agg(F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"), F.count("*").alias("sources"))


@query(S.sql("item") + "SELECT venue, starts_at::DATE AS day, lower(title) AS title, count(*) AS n, min(event_id) AS first_event FROM item WHERE starts_at IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1")
def event_identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that have venue, date and normalised title in common."""
    keys = [F.col("venue"), F.to_date("starts_at").alias("day"), text.normalize_title(F.col("title")).alias("title")]
    return S.post_item(spark, sf_dir).where("starts_at IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")).where("n > 1")


@query(f"SELECT doc_id, md5(regexp_replace(trim({_unmark('coalesce(text, chr(0))')}), '\\s+', ' ', 'g')) AS normal FROM documents")
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_title(F.col("text"))).alias("normal"))


@query("SELECT DISTINCT user_id, (ts - INTERVAL 3 HOUR)::DATE AS day FROM events")
def session_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each user and local day."""
    return S.read(spark, sf_dir, "events").select("user_id", dates.local_day(F.col("ts")).alias("day")).distinct()


@query(S.sql("venue", "rating") + "SELECT venue_id, rating FROM rating JOIN venue USING (venue_id) WHERE NOT (k % 10 = 0 AND k % 20 <> 0)")
def soft_delete_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are live after a soft deletion and a later upsert, which restores."""
    keys = S.venue(spark, sf_dir).select("venue_id", "k")
    base = S.rating(spark, sf_dir).join(keys, "venue_id").select("venue_id", "rating", "k", F.lit(0).alias("version"), F.lit(False).alias("deleted"))
    gone = base.where("k % 10 = 0").withColumns({"version": F.lit(1), "deleted": F.lit(True)})
    back = base.where("k % 20 = 0").withColumns({"version": F.lit(2), "deleted": F.lit(False)})
    after = places.keyed_latest(places.keyed_latest(base, gone, ["venue_id"], "version"), back, ["venue_id"], "version")
    return after.where("NOT deleted").select("venue_id", "rating")


@query(S.sql("venue", "rating") + "SELECT venue_id, 1 + (k % 4 = 0)::INT + (k % 8 = 0)::INT AS entries, CASE WHEN k % 8 = 0 THEN 'delete' WHEN k % 4 = 0 THEN 'update' ELSE 'insert' END AS last_action FROM rating JOIN venue USING (venue_id)")
def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log of what happened to each row, and its newest entry."""
    base = S.rating(spark, sf_dir).join(S.venue(spark, sf_dir).select("venue_id", "k"), "venue_id")
    entry = lambda rows, at, action: rows.select("venue_id", F.lit(at).alias("at"), F.lit(action).alias("action"))
    log = entry(base, 0, "insert").union(entry(base.where("k % 4 = 0"), 1, "update")).union(entry(base.where("k % 8 = 0"), 2, "delete"))
    return log.groupBy("venue_id").agg(F.count("*").cast("int").alias("entries"), F.max_by("action", "at").alias("last_action"))


@query(S.sql("venue", "rating") + "SELECT venue_id, 'old' AS origin FROM rating UNION ALL SELECT venue_id, 'new' FROM venue WHERE venue_id NOT IN (SELECT venue_id FROM rating)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = S.rating(spark, sf_dir).select("venue_id")
    new = S.venue(spark, sf_dir).select("venue_id").join(old, "venue_id", "left_anti")
    return old.withColumn("origin", F.lit("old")).union(new.withColumn("origin", F.lit("new")))


@query(S.sql("venue", "live") + "SELECT venue_id, busyness FROM live WHERE venue_id IN (SELECT venue_id FROM venue WHERE lifecycle = 'active')")
def insert_where_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots are stored for active venues only."""
    return S.live(spark, sf_dir).join(S.venue(spark, sf_dir).where("lifecycle = 'active'"), "venue_id", "left_semi").select("venue_id", "busyness")


@query(S.sql("venue") + "SELECT venue_id, name FROM venue WHERE lifecycle = 'active' AND contains(lower(name), 'o') ORDER BY name, venue_id LIMIT 20 OFFSET 20")
def venue_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a search by name (a page is the feature)."""
    rows = S.venue(spark, sf_dir).where("lifecycle = 'active'").where(F.contains(F.lower("name"), F.lit("o")))
    return rows.select("venue_id", "name").orderBy("name", "venue_id").offset(20).limit(20)


@query(S.sql("venue", "rating", "live") + "SELECT venue_id, r.venue_id IS NOT NULL AS has_rating, l.venue_id IS NOT NULL AS has_live, lat IS NOT NULL AS has_place, price_min IS NOT NULL OR price_max IS NOT NULL AS has_price FROM venue LEFT JOIN rating r USING (venue_id) LEFT JOIN live l USING (venue_id)")
def presence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.venue(spark, sf_dir).join(S.rating(spark, sf_dir), "venue_id", "left").join(S.live(spark, sf_dir), "venue_id", "left")
    there = lambda *names: F.coalesce(*names).isNotNull()
    return rows.select("venue_id", there("reviews").alias("has_rating"), there("busyness").alias("has_live"), there("lat").alias("has_place"), there("price_min", "price_max").alias("has_price"))


@query(S.sql("item", "source") + """, lineup AS (SELECT event_id, list_distinct(list(part % 50)) AS names FROM source GROUP BY 1), e AS (SELECT event_id, venue, starts_at, timezone('America/Recife', timezone('UTC', starts_at))::DATE AS night, names FROM item JOIN lineup USING (event_id) WHERE starts_at IS NOT NULL)
SELECT a.event_id, b.event_id AS other_event_id, len(list_intersect(a.names, b.names)) AS shared FROM e a JOIN e b ON a.venue = b.venue AND a.event_id < b.event_id AND (a.night = b.night OR abs(epoch(a.starts_at) - epoch(b.starts_at)) <= 8 * 3600) WHERE len(list_intersect(a.names, b.names)) >= 2""")
def lineup_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a venue's events of one night that share two names at least."""
    lineup = S.post_source(spark, sf_dir).groupBy("event_id").agg(F.collect_set(F.col("part") % 50).alias("names"))
    events = S.post_item(spark, sf_dir).select("event_id", "venue", "starts_at").join(lineup, "event_id")
    shared = F.size(F.array_intersect("names", "other_names")).cast("long")
    return happenings.candidate_pairs(events, 8).select("event_id", "other_event_id", shared.alias("shared")).where("shared >= 2")


@query(S.sql("source") + "SELECT event_id, max(seen_at) AS last_seen, TIMESTAMP '1998-06-01' - max(seen_at) <= INTERVAL 365 DAY AS current FROM source GROUP BY 1")
def menu_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items seen within a year; the last moment counts."""
    age = dates.micros(F.lit("1998-06-01 00:00:00")) - dates.micros(F.col("last_seen"))
    rows = S.post_source(spark, sf_dir).groupBy("event_id").agg(F.max("seen_at").alias("last_seen"))
    return rows.withColumn("current", age <= 365 * 86_400_000_000)


@query(S.sql("item") + "SELECT handle, count(DISTINCT venue) AS venues, array_to_string(list_sort(list(DISTINCT venue)), ',') AS venue_list FROM item GROUP BY 1")
def venues_by_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reverse index of handles; a handle has as many venues as there are."""
    pairs = S.post_item(spark, sf_dir).select("handle", "venue").distinct()
    grouped = pairs.groupBy("handle").agg(F.sort_array(F.collect_list("venue")).alias("v"))
    return grouped.select("handle", F.size("v").cast("long").alias("venues"), F.array_join("v", ",").alias("venue_list"))


@query(S.sql("item", "caption") + """, c AS (SELECT c.event_id, starts_at, o_orderdate::DATE AS posted, CASE WHEN c.event_id % 4 = 0 THEN 4 END AS weekday FROM caption c JOIN orders ON o_orderkey = c.event_id),
d AS (SELECT *, CASE WHEN starts_at IS NULL AND weekday IS NULL THEN posted WHEN starts_at IS NULL THEN posted + ((weekday - (isodow(posted) - 1) + 7) % 7)::INT ELSE (SELECT min(d) FROM (SELECT try_strptime(strftime(starts_at, '%d/%m') || '/' || (year(posted) + y), '%d/%m/%Y')::DATE AS d FROM range(2) r(y)) WHERE d IS NOT NULL AND date_diff('day', d, posted) <= 60) END AS day FROM c)
SELECT event_id, day, CASE WHEN starts_at IS NOT NULL AND isodow(day) - 1 <> weekday THEN 'weekday_mismatch' END AS reason, CASE WHEN weekday IS NOT NULL THEN '22:00' END AS clock FROM d""")
def resolved_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date and the time that a caption tells, seen from the day of its post."""
    posted = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("posted"))
    rows = S.caption(spark, sf_dir).join(posted, "event_id").withColumn("t", told.told_day(F.col("caption"), F.col("posted")))
    return rows.select("event_id", "t.day", "t.reason", dates.stated_clock(F.col("caption")).alias("clock"))


@query(S.sql("venue", "live") + """, h AS (SELECT venue_id, busyness, ntile(1) OVER () AS one FROM live) SELECT btype AS kind, count(*) AS venues, count(busyness) AS with_live, round(100.0 * count(busyness) / count(*), 4) AS percent FROM venue LEFT JOIN h USING (venue_id) GROUP BY 1""")
def live_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.venue(spark, sf_dir).join(S.live(spark, sf_dir).select("venue_id", "busyness"), "venue_id", "left")
    return rows.groupBy(F.col("btype").alias("kind")).agg(F.count("*").alias("venues"), F.count("busyness").alias("with_live"), F.round(100.0 * F.count("busyness") / F.count("*"), 4).alias("percent"))


@query(S.sql("source") + "SELECT event_id, array_to_string(list(DISTINCT handle ORDER BY handle), ',') AS handles, count(DISTINCT handle) AS n FROM source GROUP BY 1 HAVING count(DISTINCT handle) > 1")
def shared_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that several accounts announced."""
    grouped = S.post_source(spark, sf_dir).select("event_id", "handle").distinct().groupBy("event_id").agg(F.sort_array(F.collect_list("handle")).alias("h"))
    return grouped.where(F.size("h") > 1).select("event_id", F.array_join("h", ",").alias("handles"), F.size("h").cast("long").alias("n"))


@query(S.sql("source") + "SELECT event_id, source_id, row_number() OVER (PARTITION BY event_id ORDER BY seen_at NULLS LAST, source_id)::INT AS place FROM source")
def sources_oldest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("event_id").orderBy(F.asc_nulls_last("seen_at"), "source_id")
    return S.post_source(spark, sf_dir).select("event_id", "source_id", F.row_number().over(order).alias("place"))
