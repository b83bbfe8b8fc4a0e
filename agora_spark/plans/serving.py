"""Named queries on what is served: answers of searches, photos and their evidence, snapshots, closures, cards and their parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora_spark.functions import dates
from agora_spark.operators import eligibility as E
from agora_spark.operators import merging as M
from agora_spark.operators import places
from agora_spark.plans.catalog import CATEGORY, CIRCLES, CLOSURES, CROWD_MAP, DECIDED, GOOGLE_MAP, GRID, INSIDE, NEGATIONS, PHRASES, RULES, _good, _km, _said, _weekly, query
from agora_spark.plans.crawling import PHOTO, _photos
from agora_spark.sources import standins as S

ANSWER = "status string, venues array<struct<venue_id string, venue_name string, rating double, day_raw array<int>>>"


@query("SELECT 'v' || p_partkey AS venue_id, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN p_size / 10.0::DOUBLE END AS rating, (p_partkey % 7 * 24)::BIGINT AS total, 24 AS hours FROM part WHERE p_partkey % 5 <> 1")
def search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues out of the JSON answers of searches; an answer that is not OK or cannot be read has none."""
    k = F.col("p_partkey")
    one = F.struct(F.concat(F.lit("v"), k).alias("venue_id"), F.when(k % 4 != 0, F.col("p_name")).alias("venue_name"), F.when(k % 3 == 0, F.col("p_size") / 10).alias("rating"), F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: k % 7).alias("day_raw"), F.lit("x").alias("unknown"))
    body = F.to_json(F.struct(F.when(k % 5 == 1, "Error").otherwise("OK").alias("status"), F.array(one).alias("venues")))
    rows = S.read(spark, sf_dir, "part").select(F.from_json(F.when(k % 10 == 6, "{oops").otherwise(body), ANSWER).alias("a"))
    v = rows.where("a.status = 'OK'").select(F.explode("a.venues").alias("v"))
    return v.select("v.venue_id", F.col("v.venue_name").alias("name"), "v.rating", F.aggregate("v.day_raw", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("v.day_raw").alias("hours"))


@query(f"WITH {PHOTO} SELECT venue, count(*) AS photos, count_if(NOT coalesce(category = 'food' AND confidence >= 0.5, false)) AS selectable FROM photo GROUP BY 1")
def selectable_menu_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only photos that are surely illegible are dropped (the stand-in calls food photos illegible); an unknown keeps."""
    illegible = F.coalesce((F.col("category") == "food") & (F.col("confidence") >= 0.5), F.lit(False))
    return _photos(spark, sf_dir).groupBy("venue").agg(F.count("*").alias("photos"), F.count_if(~illegible).alias("selectable"))


ASKED = ("v1", "v5", "nowhere", "v9")


@query(S.sql("venue") + ", " + f"asked(id) AS (VALUES {', '.join(f'({chr(39)}{x}{chr(39)})' for x in ASKED)})" + f""" SELECT 'ids' AS mode, count(v.venue_id) AS found, count_if(v.venue_id IS NULL) AS unknown, least(count(v.venue_id), 2) AS taken FROM asked LEFT JOIN venue v ON v.venue_id = id
UNION ALL SELECT 'radius', count(*), 0, least(count(*), 10) FROM venue WHERE {_km(*S.HERE, 'lat', 'lng')} <= 5 UNION ALL SELECT 'all', count(*), 0, least(count(*), 50) FROM venue WHERE lifecycle = 'active'""")
def selected_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many venues each way to select finds, which asked ids are unknown, and what the run's cap leaves."""
    v = S.venue(spark, sf_dir)
    asked = spark.createDataFrame([(x,) for x in ASKED], "id string").join(v.select("venue_id"), F.col("id") == F.col("venue_id"), "left")
    row = lambda df, mode, cap, found=F.count("*"), unknown=F.lit(0): df.agg(found.alias("found"), unknown.cast("long").alias("unknown")).select(F.lit(mode).alias("mode"), "found", "unknown", F.least("found", F.lit(cap)).cast("long").alias("taken"))  # noqa: E731, B008
    return row(asked, "ids", 2, F.count("venue_id"), F.count_if(F.col("venue_id").isNull())).unionByName(row(places.within(v, *S.HERE, 5), "radius", 10)).unionByName(row(v.where("lifecycle = 'active'"), "all", 50))


@query("SELECT l_orderkey, l_linenumber, l_partkey, 'run=' || strftime(l_shipdate, '%Y-%m-%d') AS prefix, CASE WHEN l_partkey % 3 <> 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 'venue' ELSE 'promoter' END END AS kind, CASE WHEN l_partkey % 3 <> 0 THEN CASE WHEN l_partkey % 2 = 0 THEN 'v' || l_partkey ELSE 'h.' || l_suppkey END END AS value FROM lineitem")
def run_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run, the kind of owner and the owner that a storage key names."""
    p = F.col("l_partkey")
    owner = F.when(p % 3 == 0, F.lit("misc")).when(p % 2 == 0, F.concat(F.lit("venue=v"), p)).otherwise(F.concat(F.lit("promoter=h."), F.col("l_suppkey")))
    key = F.concat(F.lit("media/run="), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("/"), owner, F.lit("/p_1.jpg"))
    part = lambda pattern, k: F.nullif(F.regexp_extract(key, pattern, k), F.lit(""))
    form = r"(run=[^/]+)/(venue|promoter)=([^/]+)/"
    return S.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", part(r"(run=[^/]+)/", 1).alias("prefix"), part(form, 2).alias("kind"), part(form, 3).alias("value"))


@query(f"WITH {PHOTO}, shown AS (SELECT DISTINCT venue, photo_key FROM photo), evidence AS (SELECT photo_key, first(category ORDER BY pos, run) AS category, first(confidence ORDER BY pos, run) AS appeal FROM photo WHERE category IS NOT NULL GROUP BY 1) SELECT venue, photo_key, CASE category WHEN 'flyer' THEN 'Flyer' WHEN 'food' THEN 'Food' END AS label, appeal, category IS NOT NULL AS was_read FROM shown LEFT JOIN evidence USING (photo_key)")
def photo_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos with the label of the first piece of evidence that names them; those without any have none."""
    rows = _photos(spark, sf_dir)
    first = rows.where("category IS NOT NULL").groupBy("photo_key").agg(F.min(F.struct("at", "run", "category", "confidence")).alias("e"))
    out = rows.select("venue", "photo_key").distinct().join(first, "photo_key", "left")
    label = F.when(F.col("e.category") == "flyer", "Flyer").when(F.col("e.category") == "food", "Food")
    return out.select("venue", "photo_key", label.alias("label"), F.col("e.confidence").alias("appeal"), F.col("e").isNotNull().alias("was_read"))


@query(f"WITH {PHOTO}, one AS (SELECT venue, photo_key, max(coalesce(confidence, 0)) AS score FROM photo WHERE category = 'flyer' GROUP BY ALL) SELECT venue, photo_key, score FROM one QUALIFY row_number() OVER (PARTITION BY venue ORDER BY score DESC, photo_key) <= 3")
def top_relevant_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A venue's three most relevant photos (three is the feature)."""
    one = _photos(spark, sf_dir).where("category = 'flyer'").groupBy("venue", "photo_key").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("score"))
    return places.first_n_by(one, ["venue"], 3, F.desc("score"), F.asc("photo_key"))


@query(S.sql("announcement") + """, pair AS (SELECT event_id AS low, event_id + 7 AS high FROM announcement WHERE event_id % 11 = 0 AND event_id + 7 IN (SELECT event_id FROM announcement)), side AS (SELECT low AS event_id, high AS other FROM pair UNION ALL SELECT high, low FROM pair)
SELECT a.event_id, coalesce(n, 0) AS suggestions, others FROM announcement a LEFT JOIN (SELECT event_id, count(*) AS n, string_agg(other, ',' ORDER BY other) AS others FROM side GROUP BY 1) USING (event_id) WHERE status = 'pending' AND coalesce(reason, '') <> ''""")
def review_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that wait for a review, with the suggestions that name them on either side."""
    rows = S.announcement(spark, sf_dir)
    ids = rows.select("event_id")
    pair = ids.where("event_id % 11 = 0").select(F.col("event_id").alias("low"), (F.col("event_id") + 7).alias("high")).join(ids.select(F.col("event_id").alias("high")), "high")
    side = pair.select(F.col("low").alias("event_id"), F.col("high").alias("other")).unionByName(pair.select(F.col("high").alias("event_id"), F.col("low").alias("other")))
    nested = side.groupBy("event_id").agg(F.sort_array(F.collect_list("other")).alias("s"))
    waits = rows.where((F.col("status") == "pending") & M.filled(F.col("reason"))).select("event_id")
    return waits.join(nested, "event_id", "left").select("event_id", F.when(F.col("s").isNull(), 0).otherwise(F.size("s")).cast("long").alias("suggestions"), F.array_join("s", ",").alias("others"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN least(value / 1000, 0.8) ELSE value / 1000 END AS confidence, CASE WHEN event_id % 3 = 0 AND k >= 50 THEN 'second' ELSE CASE WHEN k < 50 THEN 'sure' ELSE 'first' END END AS vibe, nullif(k % 5, 0) AS legacy_level, round(value / 3, 9) AS canonical FROM (SELECT event_id, value, (props->>'$.k')::INT AS k FROM events)")
def judged_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence capped where only text was seen, a second look over uncertain labels, levels of old rows, floats as they are compared."""
    k, v = F.get_json_object("props", "$.k").cast("int"), F.col("value")
    first = F.struct(F.when(k < 50, "sure").otherwise("first").alias("vibe"), (k < 50).alias("sure"))
    second = F.when(F.col("event_id") % 3 == 0, F.lit("second"))
    rows = S.read(spark, sf_dir, "events").withColumn("f", first)
    merged = F.when(F.col("f.sure") | second.isNull(), F.col("f")).otherwise(F.col("f").withField("vibe", second))
    capped = F.when(F.col("event_id") % 2 == 0, F.least(v / 1000, F.lit(0.8))).otherwise(v / 1000)
    return rows.select("event_id", capped.alias("confidence"), merged["vibe"].alias("vibe"), F.nullif(k % 5, F.lit(0)).alias("legacy_level"), F.round(v / 3, 9).alias("canonical"))


@query(S.sql("venue", "live") + "SELECT venue_id, CASE WHEN k % 5 = 0 THEN -1 ELSE busyness END AS busyness FROM venue JOIN live USING (venue_id) WHERE k % 7 <> 0")
def live_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cycle's answers over the stored snapshots: new values replace, and what is no longer available goes."""
    stored = S.live(spark, sf_dir).join(S.venue(spark, sf_dir).select("venue_id", "k"), "venue_id")
    answers = stored.where("k % 5 = 0 OR k % 7 = 0").select("venue_id", F.when(F.col("k") % 7 != 0, -1).alias("busyness"), F.lit(1).alias("version"))
    after = places.keyed_latest(stored.select("venue_id", "busyness", F.lit(0).alias("version")), answers, ["venue_id"], "version")
    return after.where("busyness IS NOT NULL").select("venue_id", "busyness")


@query(S.sql("review") + f", {CLOSURES}, p AS (SELECT venue_id, review_id, published, CASE " + " ".join(f"WHEN {_said(p)} THEN '{p}'" for p in PHRASES) + """ END AS phrase FROM said), now AS (SELECT venue_id FROM p QUALIFY row_number() OVER (PARTITION BY venue_id ORDER BY published DESC, review_id DESC) = 1 AND phrase IS NOT NULL),
was AS (SELECT DISTINCT venue_id FROM review WHERE review_id % 3 = 0) SELECT venue_id, CASE WHEN w THEN CASE WHEN n THEN 'kept' ELSE 'cleared' END ELSE 'set' END AS change FROM (SELECT coalesce(now.venue_id, was.venue_id) AS venue_id, now.venue_id IS NOT NULL AS n, was.venue_id IS NOT NULL AS w FROM now FULL JOIN was USING (venue_id))""")
def closure_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals computed anew over those stored before: set, kept, or cleared where nothing speaks for a closure any more."""
    reviews = S.review(spark, sf_dir)
    now = E.closure_signals(reviews, PHRASES, NEGATIONS).where("closed").select("venue_id", F.lit(True).alias("n"))
    was = reviews.where("review_id % 3 = 0").select("venue_id").distinct().withColumn("w", F.lit(True))
    change = F.when(F.col("w").isNull(), "set").when(F.col("n").isNull(), "cleared").otherwise("kept")
    return now.join(was, "venue_id", "full").select("venue_id", change.alias("change"))


@query(S.sql("venue") + f", {DECIDED} SELECT venue_id FROM decided WHERE lifecycle = 'active' AND (why IS NULL OR sure = 'low') AND {INSIDE} AND NOT (k % 10 = 3 AND k % 4 <> 1)")
def servable_open_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The serving view with sure closures taken out; unsure ones stay."""
    k = F.col("k")
    closures = S.venue(spark, sf_dir).where("k % 10 = 3").select("venue_id", F.lit(True).alias("closed"), F.when(k % 4 == 1, "low").otherwise("high").alias("confidence"))
    return E.servable(S.venue(spark, sf_dir), RULES, _good(), CIRCLES, closures).select("venue_id")


@query(S.sql("venue", "live") + GRID + f""" SELECT v.venue_id, round({_km(*S.HERE, 'v.lat', 'v.lng')}, 6) AS km, {CATEGORY} AS category, CASE WHEN TIMESTAMP '{S.AS_OF}' - made < INTERVAL 10 MINUTE THEN busyness END AS live, t.grid[20] AS forecast, p.grid[2] AS night_before
FROM venue v LEFT JOIN live l ON l.venue_id = v.venue_id LEFT JOIN weekly t ON t.venue_id = v.venue_id AND t.d = 2 LEFT JOIN weekly p ON p.venue_id = v.venue_id AND p.d = 1 WHERE lifecycle = 'active' AND {_km(*S.HERE, 'v.lat', 'v.lng')} <= 8""")
def nearby_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards near a point: category, live value if it is fresh, the day's forecast and the night before's."""
    near = places.within(S.venue(spark, sf_dir).where("lifecycle = 'active'"), *S.HERE, 8)
    ids = near.select("venue_id")
    fresh = dates.freshness(dates.parse_gmttime(F.col("gmttime")), F.lit(S.AS_OF).cast("timestamp"), 10) == "fresh"
    live = S.live(spark, sf_dir).join(ids, "venue_id", "left_semi").select("venue_id", F.when(fresh, F.col("busyness")).alias("live"))
    hour = lambda d, h, name: _weekly(spark, sf_dir).where(F.col("d") == d).select("venue_id", F.get("grid", F.lit(h)).alias(name))
    rows = near.join(live, "venue_id", "left").join(hour(2, 19, "forecast"), "venue_id", "left").join(hour(1, 1, "night_before"), "venue_id", "left")
    return rows.select("venue_id", F.round("km_away", 6).alias("km"), E.category(F.col("gtype"), F.col("btype"), GOOGLE_MAP, CROWD_MAP).alias("category"), "live", "forecast", "night_before")


@query(S.sql("venue", "item", "source") + """, s AS (SELECT event_id, max(struct_pack(seen_at := seen_at, source_id := source_id, kind := kind)) AS m, min(seen_at) AS first_seen FROM source GROUP BY 1)
SELECT i.event_id, v.name AS venue_name, m.source_id AS source_id, m.kind AS source_kind, first_seen FROM item i LEFT JOIN venue v ON v.k = i.linked_venue LEFT JOIN s USING (event_id) WHERE status = 'pending'""")
def pending_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that wait for a decision, with the venue's name and the newest source."""
    from agora_spark.operators import happenings

    open_ = S.post_item(spark, sf_dir).where("status = 'pending'").select("event_id", "linked_venue")
    names = S.venue(spark, sf_dir).select(F.col("k").alias("linked_venue"), F.col("name").alias("venue_name"))
    return happenings.with_sources(open_.join(names, "linked_venue", "left").select("event_id", "venue_name"), S.post_source(spark, sf_dir)).select("event_id", "venue_name", "source_id", "source_kind", "first_seen")


@query(S.sql("venue", "rating") + f", {DECIDED} SELECT coalesce(gtype, 'unknown') AS kind, count(*) AS venues, count_if(lifecycle = 'active') AS active, count_if(lifecycle = 'deprecated' AND venue_source = 'google_only') AS gone_map, count_if(lifecycle = 'deprecated' AND venue_source <> 'google_only') AS gone_crowd, count_if(lifecycle = 'active' AND (why IS NULL OR sure = 'low') AND {INSIDE}) AS served, count(r.venue_id) AS rated FROM decided LEFT JOIN rating r USING (venue_id) GROUP BY 1")
def counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues of each type: active, deprecated by source, served, rated."""
    from agora_spark.plans.catalog import _decided

    rows = _decided(spark, sf_dir).join(S.rating(spark, sf_dir), "venue_id", "left")
    active, gone = F.col("lifecycle") == "active", F.col("lifecycle") == "deprecated"
    served = active & (F.col("verdict.eligible") | (F.col("verdict.confidence") == "low")) & E.inside_fence(F.col("lat"), F.col("lng"), CIRCLES)
    n = {"active": active, "gone_map": gone & (F.col("venue_source") == "google_only"), "gone_crowd": gone & (F.col("venue_source") != "google_only"), "served": served}
    return rows.groupBy(F.coalesce("gtype", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("venues"), *(F.count_if(c).alias(name) for name, c in n.items()), F.count("reviews").alias("rated"))


@query("SELECT event_type, count(*) AS kept FROM events WHERE NOT (user_id % 10 = 3 AND ts < TIMESTAMP '2024-01-20') GROUP BY 1")
def hard_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays after soft deleted rows beyond their time are purged."""
    rows = S.read(spark, sf_dir, "events").withColumn("deleted_at", F.when(F.col("user_id") % 10 == 3, F.col("ts")))
    purged = rows.where(F.col("deleted_at") < F.lit("2024-01-20").cast("timestamp_ntz")).select("event_id")
    return rows.join(purged, "event_id", "left_anti").groupBy("event_type").agg(F.count("*").alias("kept"))
