"""The named queries over the stand-in tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora_spark.functions import dates, price, sets, text
from agora_spark.operators import eligibility as E
from agora_spark.operators import engagement, graph, happenings, places
from agora_spark.sources import lake
from agora_spark.sources import standins as S

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# The rule tables of the stand-ins.
GOOGLE_MAP = {"brand#1": "BAR", "brand#2": "RESTAURANT", "brand#3": "NIGHTCLUB", "brand#4": "CAFE", "brand#5": "RESTAURANT"}
CROWD_MAP = {"PROMO": "BAR", "SMALL": "PUB", "LARGE": "CLUB"}
RULES = {"google": ["brand#9", "brand#10"], "crowd": ["ECONOMY"], "hard": ["anvil", "gear"], "ambiguous": ["hot", "old"]}
CIRCLES = [(-8.0476, -34.877, 25.0), (-7.9, -34.7, 9.5)]
GENERIC, STOP = ["show", "live", "band"], ["de", "do", "the"]
PHRASES, NEGATIONS = ["license", "the and", "der die"], ["under", "of the"]


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _case(mapping: dict[str, str], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def _within(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _km(lat1, lng1, lat2, lng2, radius=6371.0088) -> str:
    return f"2 * {radius} * asin(sqrt(least(1.0, pow(sin(radians(({lat2}) - ({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians(({lng2}) - ({lng1})) / 2), 2))))"


CATEGORY = f"CASE WHEN ({_case(GOOGLE_MAP, 'gtype')}) = 'RESTAURANT' AND ({_case(CROWD_MAP, 'btype')}) IN ('BAR', 'PUB') THEN ({_case(CROWD_MAP, 'btype')}) ELSE coalesce(({_case(GOOGLE_MAP, 'gtype')}), ({_case(CROWD_MAP, 'btype')}), 'OTHER') END"
DECIDED = f"""decided AS (SELECT *, {CATEGORY} AS category, CASE WHEN trim(name) = '' THEN 'empty_name' WHEN gtype IN ({_list(RULES['google'])}) THEN 'google_type' WHEN btype IN ({_list(RULES['crowd'])}) THEN 'besttime_type'
  WHEN {CATEGORY} = 'OTHER' AND {_within('lower(name)', RULES['hard'] + RULES['ambiguous'])} THEN 'name_keyword' END AS why,
  CASE WHEN trim(name) <> '' AND gtype IS NULL AND btype NOT IN ({_list(RULES['crowd'])}) AND {CATEGORY} = 'OTHER' AND NOT {_within('lower(name)', RULES['hard'])} AND {_within('lower(name)', RULES['ambiguous'])} THEN 'low' ELSE 'high' END AS sure FROM venue)"""
INSIDE = "(lat IS NULL OR " + " OR ".join(f"{_km(a, o, 'lat', 'lng')} <= {km}" for a, o, km in CIRCLES) + ")"
CLOSURES = "said AS (SELECT venue_id, review_id, published, lower(coalesce(text, '')) AS t FROM review WHERE published IS NOT NULL)"


def _good():
    return E.category(F.col("gtype"), F.col("btype"), GOOGLE_MAP, CROWD_MAP) != "OTHER"


def _decided(spark, sf_dir):
    verdict = E.decide(F.col("name"), F.col("btype"), F.col("gtype"), RULES, _good())
    return S.venue(spark, sf_dir).withColumn("verdict", verdict)


@query(S.sql("venue", "rating") + f"""SELECT venue_id, name, km, level, price_source, reviews FROM (
  SELECT venue_id, name, round({_km(*S.HERE, 'lat', 'lng')}, 6) AS km, level, CASE WHEN by_range IS NOT NULL THEN 'google_range' WHEN by_label IS NOT NULL THEN 'google_enum' WHEN level IS NOT NULL THEN 'besttime' END AS price_source, coalesce(reviews, 0) AS reviews
  FROM (SELECT *, coalesce(by_range, by_label, CASE WHEN crowd_price BETWEEN 1 AND 4 THEN crowd_price END) AS level FROM (SELECT *,
    CASE WHEN currency = 'BRL' THEN CASE WHEN stat < 40 THEN 1 WHEN stat < 70 THEN 2 WHEN stat < 110 THEN 3 WHEN stat IS NOT NULL THEN 4 END END AS by_range,
    CASE price_label WHEN 'PRICE_LEVEL_INEXPENSIVE' THEN 1 WHEN 'PRICE_LEVEL_MODERATE' THEN 2 WHEN 'PRICE_LEVEL_EXPENSIVE' THEN 3 WHEN 'PRICE_LEVEL_VERY_EXPENSIVE' THEN 4 END AS by_label
    FROM (SELECT *, CASE WHEN price_min IS NULL THEN price_max WHEN price_max IS NULL THEN price_min ELSE (price_min + price_max) / 2 END AS stat FROM venue))) LEFT JOIN rating USING (venue_id)
  WHERE lifecycle = 'active') WHERE km <= 20 ORDER BY reviews DESC, venue_id LIMIT 50""")
def nearby_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = places.within(S.venue(spark, sf_dir).where("lifecycle = 'active'"), *S.HERE, 20)
    signal = price.price_signal(F.col("price_label"), F.col("currency"), F.col("price_min"), F.col("price_max"), F.col("crowd_price"))
    rows = near.join(S.rating(spark, sf_dir, near.select("k")), "venue_id", "left").withColumn("p", signal)
    out = rows.select("venue_id", "name", F.round("km_away", 6).alias("km"), F.col("p.level").alias("level"), F.col("p.source").alias("price_source"), F.coalesce("reviews", F.lit(0)).alias("reviews"))
    return out.orderBy(F.desc("reviews"), "venue_id").limit(50)


@query(S.sql("venue") + f", {DECIDED} SELECT venue_id, category, why IS NULL AS eligible, why AS reason, sure AS confidence FROM decided")
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = E.category(F.col("gtype"), F.col("btype"), GOOGLE_MAP, CROWD_MAP)
    return _decided(spark, sf_dir).select("venue_id", category.alias("category"), "verdict.eligible", "verdict.reason", "verdict.confidence")


@query(S.sql("venue") + f", {DECIDED} SELECT coalesce(why, 'eligible') AS reason, sure AS confidence, count(*) AS venues FROM decided GROUP BY 1, 2")
def eligibility_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).groupBy(F.coalesce("verdict.reason", F.lit("eligible")).alias("reason"), F.col("verdict.confidence").alias("confidence")).agg(F.count("*").alias("venues"))


@query(S.sql("venue") + f", {DECIDED} SELECT venue_id FROM decided WHERE lifecycle = 'active' AND (why IS NULL OR sure = 'low') AND {INSIDE}")
def servable_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.servable(S.venue(spark, sf_dir), RULES, _good(), CIRCLES).select("venue_id")


@query(S.sql("venue") + f"SELECT count_if(NOT {INSIDE}) AS excluded, count_if(lat IS NULL) AS unplaced, count(*) AS active FROM venue WHERE lifecycle = 'active'")
def geo_excluded_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = E.inside_fence(F.col("lat"), F.col("lng"), CIRCLES)
    return S.venue(spark, sf_dir).where("lifecycle = 'active'").agg(F.count_if(~inside).alias("excluded"), F.count_if(F.col("lat").isNull()).alias("unplaced"), F.count("*").alias("active"))


@query(S.sql("venue") + f""", points AS (SELECT k AS point, lat AS p_lat, lng AS p_lng FROM venue WHERE k % 50 = 0 AND lat IS NOT NULL)
SELECT point, count(v.k) AS venues FROM points LEFT JOIN (SELECT * FROM venue WHERE lifecycle = 'active') v ON {_km('p_lat', 'p_lng', 'lat', 'lng')} <= 3 GROUP BY point""")
def point_venue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.venue(spark, sf_dir)
    points = v.where("k % 50 = 0 AND lat IS NOT NULL").select(F.col("k").alias("point"), "lat", "lng")
    return places.counts_within(points, v.where("lifecycle = 'active'"), 3)


TOP = "ORDER BY priority, reviews DESC NULLS LAST, rating DESC NULLS LAST, venue_id LIMIT 40"


def _top(rows: DataFrame, k: int) -> DataFrame:
    """The k most urgent venues; none for k under 1."""
    order = [F.asc("priority"), F.desc_nulls_last("reviews"), F.desc_nulls_last("rating"), F.asc("venue_id")]
    return rows.orderBy(*order).limit(max(0, k)).select("venue_id", "priority", "reviews", "rating")


@query(S.sql("venue", "rating") + f"SELECT venue_id, priority, reviews, rating FROM venue LEFT JOIN rating USING (venue_id) WHERE lifecycle = 'active' AND venue_source <> 'google_only' {TOP}")
def refresh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.venue(spark, sf_dir).where("lifecycle = 'active' AND venue_source <> 'google_only'")
    return _top(rows.join(S.rating(spark, sf_dir), "venue_id", "left"), 40)


@query(S.sql("venue", "rating") + f", {DECIDED} SELECT venue_id, priority, reviews, rating FROM decided LEFT JOIN rating USING (venue_id) WHERE lifecycle = 'active' AND (why IS NULL OR sure = 'low') AND {INSIDE} {TOP}")
def servable_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.servable(S.venue(spark, sf_dir), RULES, _good(), CIRCLES)
    return _top(rows.join(S.rating(spark, sf_dir), "venue_id", "left"), 40)


@query(S.sql("venue") + f"SELECT coalesce(gtype, 'unknown') AS kind, {CATEGORY} AS category, count(*) AS venues FROM venue GROUP BY 1, 2")
def venue_type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    category = E.category(F.col("gtype"), F.col("btype"), GOOGLE_MAP, CROWD_MAP)
    return S.venue(spark, sf_dir).groupBy(F.coalesce("gtype", F.lit("unknown")).alias("kind"), category.alias("category")).agg(F.count("*").alias("venues"))


@query(S.sql("venue") + f", rule(value) AS (VALUES {', '.join(f'({chr(39)}{g}{chr(39)})' for g in RULES['google'] + ['brand#99'])}) SELECT value AS rule, count(k) AS venues, count(*) FILTER (lifecycle = 'active') AS active, count(*) FILTER (lifecycle = 'deprecated') AS deprecated FROM rule LEFT JOIN venue ON gtype = value GROUP BY 1")
def rule_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([(g,) for g in RULES["google"] + ["brand#99"]], "rule string")
    joined = rules.join(S.venue(spark, sf_dir), F.col("rule") == F.col("gtype"), "left")
    return joined.groupBy("rule").agg(F.count("k").alias("venues"), F.count_if(F.col("lifecycle") == "active").alias("active"), F.count_if(F.col("lifecycle") == "deprecated").alias("deprecated"))


@query(S.sql("venue") + ", reasons(reason) AS (VALUES ('eligibility'), ('closed'), ('manual'), ('merged')) SELECT r.reason, count(k) AS venues, coalesce(max(k), -1) AS newest FROM reasons r LEFT JOIN venue v ON v.reason = r.reason AND lifecycle = 'deprecated' GROUP BY 1")
def reason_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = spark.createDataFrame([("eligibility",), ("closed",), ("manual",), ("merged",)], "why string")
    gone = S.venue(spark, sf_dir).where("lifecycle = 'deprecated'")
    return reasons.join(gone, F.col("why") == F.col("reason"), "left").groupBy(F.col("why").alias("reason")).agg(F.count("k").alias("venues"), F.coalesce(F.max("k"), F.lit(-1)).alias("newest"))


@query(S.sql("venue", "rating", "live") + "SELECT count(*) AS venues, count(lat) AS placed, count(gtype) AS typed, count(price_label) AS labelled, count(price_min) AS priced, count(r.venue_id) AS rated, count(l.venue_id) AS live, round(avg(rating), 6) AS mean_rating, round(avg(reviews), 6) AS mean_reviews FROM venue LEFT JOIN rating r USING (venue_id) LEFT JOIN live l USING (venue_id) WHERE lifecycle = 'active'")
def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.venue(spark, sf_dir).where("lifecycle = 'active'").join(S.rating(spark, sf_dir), "venue_id", "left").join(S.live(spark, sf_dir), "venue_id", "left")
    named = {"placed": "lat", "typed": "gtype", "labelled": "price_label", "priced": "price_min", "rated": "rating", "live": "gmttime"}
    return rows.agg(F.count("*").alias("venues"), *(F.count(c).alias(n) for n, c in named.items()), F.round(F.avg("rating"), 6).alias("mean_rating"), F.round(F.avg("reviews"), 6).alias("mean_reviews"))


PRICED = """, priced AS (SELECT *, CASE WHEN by_range IS NOT NULL THEN 'google_range' WHEN by_label IS NOT NULL THEN 'google_enum' WHEN level IS NOT NULL THEN 'besttime' END AS src FROM (SELECT *, coalesce(by_range, by_label, CASE WHEN crowd_price BETWEEN 1 AND 4 THEN crowd_price END) AS level FROM (SELECT *,
    CASE WHEN currency = 'BRL' THEN CASE WHEN stat < 40 THEN 1 WHEN stat < 70 THEN 2 WHEN stat < 110 THEN 3 WHEN stat IS NOT NULL THEN 4 END END AS by_range,
    CASE price_label WHEN 'PRICE_LEVEL_INEXPENSIVE' THEN 1 WHEN 'PRICE_LEVEL_EXPENSIVE' THEN 3 END AS by_label FROM (SELECT *, CASE WHEN price_min IS NULL THEN price_max WHEN price_max IS NULL THEN price_min ELSE (price_min + price_max) / 2 END AS stat FROM venue)))) """


def _priced(spark, sf_dir):
    signal = price.price_signal(F.col("price_label"), F.col("currency"), F.col("price_min"), F.col("price_max"), F.col("crowd_price"))
    return S.venue(spark, sf_dir).withColumn("p", signal)


@query(S.sql("venue") + PRICED + "SELECT venue_id, level, src AS source FROM priced")
def price_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _priced(spark, sf_dir).select("venue_id", F.col("p.level").alias("level"), F.col("p.source").alias("source"))


@query(S.sql("venue") + PRICED + "SELECT nullif(crowd_price, 0) AS before, level AS after, count(*) AS venues FROM priced WHERE nullif(crowd_price, 0) IS DISTINCT FROM level GROUP BY 1, 2")
def price_distribution_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.nullif(F.col("crowd_price"), F.lit(0))
    rows = _priced(spark, sf_dir).select(before.alias("before"), F.col("p.level").alias("after"))
    return rows.where(~F.col("before").eqNullSafe(F.col("after"))).groupBy("before", "after").agg(F.count("*").alias("venues"))


@query(S.sql("live") + f"SELECT venue_id, busyness, CASE WHEN made IS NULL THEN 'unparseable' WHEN TIMESTAMP '{S.AS_OF}' - made < INTERVAL 10 MINUTE THEN 'fresh' ELSE 'stale' END AS verdict FROM live")
def live_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = dates.freshness(dates.parse_gmttime(F.col("gmttime")), F.lit(S.AS_OF).cast("timestamp"), dates.max_age_minutes(5))
    return S.live(spark, sf_dir).select("venue_id", "busyness", verdict.alias("verdict"))


@query(S.sql("venue", "live") + f"SELECT venue_id, CASE WHEN TIMESTAMP '{S.AS_OF}' - made < INTERVAL 10 MINUTE THEN busyness END AS busyness, row_number() OVER (ORDER BY l.venue_id IS NULL, busyness DESC NULLS LAST, venue_id) AS place FROM venue LEFT JOIN live l USING (venue_id) WHERE lifecycle = 'active' AND {_km(*S.HERE, 'lat', 'lng')} <= 5")
def live_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live venues first, by raw busyness; a stale value orders but is not shown."""
    near = places.within(S.venue(spark, sf_dir).where("lifecycle = 'active'"), *S.HERE, 5).join(S.live(spark, sf_dir), "venue_id", "left")
    fresh = dates.freshness(dates.parse_gmttime(F.col("gmttime")), F.lit(S.AS_OF).cast("timestamp"), 10) == "fresh"
    rows = near.select("venue_id", "busyness", F.col("gmttime").isNull().alias("last"), fresh.alias("fresh"))
    out = places.ranked(rows, [], F.col("last"), F.desc_nulls_last("busyness"), F.col("venue_id"))
    return out.select("venue_id", F.when(F.col("fresh"), F.col("busyness")).alias("busyness"), "place")


GRID = ", day(d) AS (SELECT unnest(range(7))), weekly AS (SELECT venue_id, k, d, list_transform(range(24), lambda h: (k * 7 + d * 3 + h * 5) % 101) AS grid FROM venue, day WHERE (k + d) % 6 <> 0)"


def _weekly(spark, sf_dir):
    days = S.venue(spark, sf_dir).select("venue_id", "k", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("d"))
    return days.where((F.col("k") + F.col("d")) % 6 != 0).withColumn("grid", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: (F.col("k") * 7 + F.col("d") * 3 + h * 5) % 101))


@query(S.sql("venue") + GRID + " SELECT venue_id, count(*) AS days, max(list_max(grid)) AS peak, sum(list_sum(grid))::BIGINT AS total FROM weekly GROUP BY 1")
def weekly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weekly(spark, sf_dir).groupBy("venue_id").agg(F.count("*").alias("days"), F.max(F.array_max("grid")).alias("peak"), F.sum(F.aggregate("grid", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total"))


@query(S.sql("venue") + GRID + " SELECT v.venue_id, t.grid[19] AS evening, p.grid[24] AS last_night FROM venue v LEFT JOIN weekly t ON t.venue_id = v.venue_id AND t.d = 0 LEFT JOIN weekly p ON p.venue_id = v.venue_id AND p.d = 6")
def forecast_today_and_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monday's evening hour, and the last hour of the day before (the weekday wraps)."""
    w, today = _weekly(spark, sf_dir), 0
    t = w.where(F.col("d") == today).select("venue_id", F.get("grid", F.lit(18)).alias("evening"))
    p = w.where(F.col("d") == (today - 1) % 7).select("venue_id", F.get("grid", F.lit(23)).alias("last_night"))
    return S.venue(spark, sf_dir).select("venue_id").join(t, "venue_id", "left").join(p, "venue_id", "left")


@query(S.sql("venue") + GRID + """, text AS (SELECT v.venue_id, day.d, CASE WHEN w.d IS NULL OR (v.k + day.d) % 4 = 1 AND list_sum(w.grid) = 0 THEN 'closed' WHEN (v.k + day.d) % 4 = 1 THEN 'unavailable'
  WHEN (v.k + day.d) % 4 = 2 THEN printf('%02d:30-%02d:00, 19:00-02:15', (8 + v.k % 4)::INT, (12 + day.d % 3)::INT) ELSE printf('%02d:00-%02d:30', (10 + v.k % 8)::INT, ((20 + day.d) % 24)::INT) END AS t
  FROM venue v CROSS JOIN day LEFT JOIN weekly w ON w.venue_id = v.venue_id AND w.d = day.d) SELECT venue_id, string_agg(d || ': ' || t, '; ' ORDER BY d) AS hours FROM text GROUP BY 1""")
def hours_from_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening hours of the seven days, from the spans and the grid of the weekly forecast; a day without forecast is closed."""
    k, d = F.col("k"), F.col("d")
    span = lambda o, om, c, cm: F.struct(o.cast("int").alias("opens"), F.lit(om).cast("int").alias("opens_minutes"), c.cast("int").alias("closes"), F.lit(cm).cast("int").alias("closes_minutes"))
    one, two = F.array(span(10 + k % 8, None, (20 + d) % 24, 30)), F.array(span(8 + k % 4, 30, 12 + d % 3, 0), span(F.lit(19), 0, F.lit(2), 15))
    w = _weekly(spark, sf_dir).withColumn("spans", F.when((k + d) % 4 == 2, two).when((k + d) % 4 != 1, one))
    told = w.groupBy("venue_id").agg(F.map_from_entries(F.collect_list(F.struct("d", dates.hours_text(F.col("spans"), F.col("grid"))))).alias("by_day"))
    days = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.concat(i.cast("string"), F.lit(": "), F.coalesce(F.element_at("by_day", i), F.lit("closed"))))
    return told.select("venue_id", F.array_join(days, "; ").alias("hours"))


@query(S.sql("item") + "SELECT event_id, venue, starts_at, title, status FROM item WHERE status = 'confirmed' AND starts_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-06-30'")
def event_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.post_item(spark, sf_dir).where("status = 'confirmed' AND starts_at BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-06-30'")
    return rows.select("event_id", "venue", "starts_at", "title", "status")


@query(S.sql("item", "source") + """, s AS (SELECT event_id, max(struct_pack(seen_at := seen_at, source_id := source_id)) AS m, min(seen_at) AS first_seen, max(seen_at) AS last_seen FROM source GROUP BY 1)
SELECT i.event_id, i.status, m.source_id AS source_id, first_seen, last_seen FROM item i LEFT JOIN s USING (event_id) WHERE status = 'pending' OR (linked_venue IS NULL AND status <> 'rejected')""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = S.post_item(spark, sf_dir).where("status = 'pending' OR (linked_venue IS NULL AND status NOT IN ('rejected', 'superseded'))")
    return happenings.with_sources(open_.select("event_id", "status"), S.post_source(spark, sf_dir)).select("event_id", "status", "source_id", "first_seen", "last_seen")


@query(S.sql("item", "source") + "SELECT event_id, title FROM item WHERE EXISTS (SELECT 1 FROM source s WHERE s.event_id = item.event_id AND s.handle = 'h7')")
def events_by_handle(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = S.post_source(spark, sf_dir).where("handle = 'h7'").select("event_id")
    return S.post_item(spark, sf_dir).join(said, "event_id", "left_semi").select("event_id", "title")


@query(S.sql("source") + "SELECT event_id FROM source GROUP BY 1 HAVING bool_and(kind = 'promoter')")
def promoter_only_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return happenings.hidden(S.post_source(spark, sf_dir))


@query("WITH tiers(tier) AS (VALUES (0), (1), (2), (3), (4), (5), (6)) SELECT tier, count(p_partkey) AS venues FROM tiers LEFT JOIN part ON p_size % 6 = tier GROUP BY 1")
def tier_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = spark.range(7).select(F.col("id").cast("int").alias("tier"))
    n = S.venue(spark, sf_dir).groupBy("priority").agg(F.count("*").alias("n"))
    return tiers.join(n, F.col("tier") == F.col("priority"), "left").select("tier", F.coalesce("n", F.lit(0)).alias("venues"))


@query(S.sql("item") + "SELECT event_id, substr(sha256(lower(title) || '|' || coalesce(strftime(starts_at, '%Y-%m-%d'), '')), 1, 32) AS source_key FROM item")
def event_source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.post_item(spark, sf_dir).select("event_id", happenings.source_key(F.col("title"), F.col("starts_at")).alias("source_key"))


@query(S.sql("item") + """SELECT venue, starts_at::DATE AS day, lower(title) AS title, count(*) AS n, CASE WHEN count_if(status = 'confirmed') = 1 THEN min(event_id) FILTER (status = 'confirmed') WHEN count_if(status = 'confirmed') = 0 THEN min(event_id) END AS canonical
FROM item WHERE starts_at IS NOT NULL GROUP BY 1, 2, 3""")
def canonical_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return happenings.canonical(S.post_item(spark, sf_dir), F.col("status") == "confirmed")


WORDS = f", words AS MATERIALIZED (SELECT event_id, venue, starts_at, timezone('America/Recife', timezone('UTC', starts_at)) AS local, list_distinct(list_filter(regexp_split_to_array(lower(title), '[^0-9a-z]+'), lambda t: t <> '' AND NOT list_contains([{_list(GENERIC + STOP)}], t) AND len(t) >= 2)) AS w FROM item WHERE starts_at IS NOT NULL)"
JUDGED = """, tok AS (SELECT *, unnest(w) AS t FROM words), judged AS MATERIALIZED (SELECT a.venue, a.event_id, b.event_id AS other_event_id, CASE WHEN list_has_all(a.w, b.w) OR list_has_all(b.w, a.w) THEN 'auto' ELSE 'suggest' END AS band
  FROM tok a JOIN tok b ON a.venue = b.venue AND a.t = b.t AND a.event_id < b.event_id AND (a.local::DATE = b.local::DATE OR abs(epoch(a.starts_at) - epoch(b.starts_at)) <= 8 * 3600) WHERE a.t = list_min(list_intersect(a.w, b.w)))"""


@query(S.sql("item") + WORDS + JUDGED + " SELECT venue, event_id, other_event_id, band FROM judged")
def pair_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return happenings.judged_pairs(S.post_item(spark, sf_dir), GENERIC, STOP)


@query(S.sql("item") + WORDS + JUDGED + " SELECT band, count(*) AS pairs, count(DISTINCT venue) AS venues FROM judged GROUP BY 1")
def pair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return happenings.judged_pairs(S.post_item(spark, sf_dir), GENERIC, STOP).groupBy("band").agg(F.count("*").alias("pairs"), F.count_distinct("venue").alias("venues"))


@query("WITH RECURSIVE " + S.SQL["item"] + WORDS + JUDGED + """, edge AS (SELECT event_id AS a, other_event_id AS b FROM judged UNION SELECT other_event_id, event_id FROM judged),
walk(node, seen) AS (SELECT a, a FROM edge UNION SELECT e.b, w.seen FROM walk w JOIN edge e ON e.a = w.node) SELECT node AS event_id, min(seen) AS component FROM walk GROUP BY 1""")
def event_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = happenings.judged_pairs(S.post_item(spark, sf_dir), GENERIC, STOP)
    return graph.connected(pairs.select(F.col("event_id").alias("a"), F.col("other_event_id").alias("b"))).select(F.col("node").alias("event_id"), "component")


@query(S.sql("item") + f""", w AS (SELECT event_id, venue, handle, starts_at, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(title), '[^0-9a-z]+'), lambda t: t <> '' AND NOT list_contains([{_list(GENERIC + STOP)}], t) AND (len(t) >= 2 OR regexp_matches(t, '^[0-9]$'))))) AS words FROM item)
SELECT u.event_id, min(struct_pack(gap := abs(epoch_us(o_orderdate) - epoch_us(d.starts_at)), id := d.event_id)).id AS "into" FROM w u JOIN orders ON o_orderkey = u.event_id JOIN w d ON d.venue = u.venue AND d.handle = u.handle AND d.words = u.words AND len(u.words) > 0
WHERE u.starts_at IS NULL AND d.starts_at IS NOT NULL AND abs(epoch_us(o_orderdate) - epoch_us(d.starts_at)) <= 14 * 86400000000 GROUP BY 1""")
def undated_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-15 by its rule: venue, handle, distinctive words of the real title, 14 days. The stand-in has no venue names."""
    items = S.post_item(spark, sf_dir).select("event_id", "venue", "handle", "title", "starts_at", F.lit(None).cast("string").alias("venue_name"))
    posted = S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_orderdate").alias("posted"))
    return happenings.undated_twins(items.where("starts_at IS NULL").join(posted, "event_id"), items.where("starts_at IS NOT NULL"), GENERIC, STOP)


@query(S.sql("venue") + f"SELECT a.venue_id, b.venue_id AS other_venue_id, round({_km('a.lat', 'a.lng', 'b.lat', 'b.lng', 6371.0)}, 6) AS km FROM venue a JOIN venue b ON a.k < b.k AND a.lat IS NOT NULL AND (trim(a.name) = trim(b.name) AND trim(a.name) <> '' OR least(length(trim(a.name)), length(trim(b.name))) >= 5 AND (contains(trim(a.name), trim(b.name)) OR contains(trim(b.name), trim(a.name)))) AND {_km('a.lat', 'a.lng', 'b.lat', 'b.lng', 6371.0)} <= 0.05")
def duplicate_venue_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.duplicate_pairs(S.venue(spark, sf_dir), 50).select("venue_id", "other_venue_id", F.round("km_away", 6).alias("km"))


MATCHED = f"pair AS (SELECT a.k AS a, b.k AS b FROM venue a JOIN venue b ON a.k < b.k AND a.lat IS NOT NULL AND (trim(a.name) = trim(b.name) AND trim(a.name) <> '' OR least(length(trim(a.name)), length(trim(b.name))) >= 5 AND (contains(trim(a.name), trim(b.name)) OR contains(trim(b.name), trim(a.name)))) AND {_km('a.lat', 'a.lng', 'b.lat', 'b.lng', 6371.0)} <= 0.05)"


@query("WITH RECURSIVE " + S.SQL["venue"] + f", {MATCHED}" + """, node AS (SELECT k, row_number() OVER (ORDER BY k) AS r FROM (SELECT a AS k FROM pair UNION SELECT b FROM pair)), below AS (SELECT b AS k, list(a ORDER BY a) AS near FROM pair GROUP BY 1),
walk(r, heads, k, head) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT UNION ALL SELECT j.step, CASE WHEN h IS NULL THEN list_append(heads, j.node) ELSE heads END, j.node, coalesce(h, j.node) FROM (SELECT w.heads, n.r AS step, n.k::BIGINT AS node, list_min(list_intersect(w.heads, coalesce(near, []))) AS h FROM walk w JOIN node n ON n.r = w.r + 1 LEFT JOIN below ON below.k = n.k) j)
SELECT head, k FROM walk WHERE head IN (SELECT head FROM walk GROUP BY 1 HAVING count(*) > 1)""")
def duplicate_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.duplicate_groups(S.venue(spark, sf_dir), 50)


MENTIONED = r", m AS (SELECT DISTINCT event_id, regexp_replace(u, '\.+$', '') AS handle FROM (SELECT event_id, unnest(regexp_extract_all(lower(caption), '(?:^|[^\w.])@([a-z0-9_.]+)', 1)) AS u FROM caption))"


@query(S.sql("item", "caption") + MENTIONED + " SELECT handle, count(*) AS posts, min(event_id) AS first_event FROM m GROUP BY 1 HAVING count(*) >= 3")
def mention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.caption(spark, sf_dir).select("event_id", F.explode(text.mentions(F.col("caption"))).alias("handle"))
    return m.groupBy("handle").agg(F.count("*").alias("posts"), F.min("event_id").alias("first_event")).where("posts >= 3")


@query(S.sql("item", "caption") + MENTIONED + " SELECT handle, count(*) AS posts FROM m WHERE handle NOT IN (SELECT replace(p_name, ' ', '_') FROM part WHERE p_partkey % 2 = 0) AND handle NOT IN (SELECT 'h' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0) GROUP BY 1 HAVING count(*) >= 3")
def promoter_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = S.caption(spark, sf_dir).select("event_id", F.explode(text.mentions(F.col("caption"))).alias("handle"))
    known = S.read(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("handle"))
    registered = S.read(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("h"), "s_suppkey").alias("handle"))
    return m.groupBy("handle").agg(F.count("*").alias("posts")).where("posts >= 3").join(known, "handle", "left_anti").join(registered, "handle", "left_anti")


@query(S.sql("item", "caption") + r"""SELECT event_id, array_to_string(list_filter([CASE WHEN regexp_matches(lower(caption), '\b\d{1,2}[/.\-]\d{1,2}(?:[/.\-]\d{2,4})?\b') THEN 'date' END,
  CASE WHEN regexp_matches(lower(caption), '\bsexta\b[\w\-,.!\s]{0,40}?\d{1,2}[:h]\d{0,2}\b') THEN 'weekday_time' END, CASE WHEN contains(caption, 'ingressos') THEN 'term:ingressos' END, CASE WHEN contains(caption, 'ingresso') THEN 'term:ingresso' END, CASE WHEN contains(caption, 'open bar') THEN 'term:open bar' END], lambda x: x IS NOT NULL), ',') AS markers FROM caption""")
def caption_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.caption(spark, sf_dir).select("event_id", F.array_join(text.event_markers(F.col("caption")), ",").alias("markers"))


@query(S.sql("item", "caption") + r"""SELECT venue, count(*) AS posts, count_if(contains(caption, 'ingressos') OR contains(caption, 'sexta')) AS matches, array_to_string(list_slice(list(left(caption, 140) ORDER BY event_id) FILTER (contains(caption, 'ingressos') OR contains(caption, 'sexta')), 1, 3), ' | ') AS excerpts FROM caption GROUP BY 1""")
def caption_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.contains("caption", F.lit("ingressos")) | F.contains("caption", F.lit("sexta"))
    rows = S.caption(spark, sf_dir).withColumn("hit", hit)
    ranked = rows.where("hit").withColumn("r", F.row_number().over(Window.partitionBy("venue").orderBy("event_id"))).where("r <= 3")
    texts = ranked.groupBy("venue").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.left("caption", F.lit(140)).alias("c")))), lambda s: s["c"]), " | ").alias("excerpts"))
    return rows.groupBy("venue").agg(F.count("*").alias("posts"), F.count_if("hit").alias("matches")).join(texts, "venue", "left")


def _unmark(x: str) -> str:
    return f"strip_accents(replace(lower({x}), 'ß', 'ss'))"


@query(f"SELECT doc_id, md5(trim(regexp_replace({_unmark('coalesce(text, chr(0))')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) AS folded FROM documents")
def fold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold_text(F.col("text"))).alias("folded"))


@query(f"SELECT doc_id, md5(regexp_replace({_unmark('text')}, '[^a-z0-9]', '', 'g')) AS ascii, len(list_distinct(list_filter(regexp_split_to_array({_unmark('text')}, '[^0-9a-z]+'), lambda t: t <> ''))) AS tokens FROM documents")
def title_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return S.read(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold_ascii(t)).alias("ascii"), F.size(text.title_tokens(t)).cast("long").alias("tokens"))


def _said(phrase: str) -> str:
    around = f"right(array_to_string(list_slice(string_split(t, '{phrase}'), 1, i), '{phrase}'), 40) || '{phrase}' || left(array_to_string(list_slice(string_split(t, '{phrase}'), i + 1, len(string_split(t, '{phrase}'))), '{phrase}'), 40)"
    return f"len(list_filter(range(1, len(string_split(t, '{phrase}'))), lambda i: NOT ({' OR '.join(f'contains({around}, {chr(39)}{n}{chr(39)})' for n in NEGATIONS)}))) > 0"


@query(S.sql("review") + f", {CLOSURES}, p AS (SELECT venue_id, review_id, published, CASE " + " ".join(f"WHEN {_said(p)} THEN '{p}'" for p in PHRASES) + """ END AS phrase FROM said),
n AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY venue_id ORDER BY published DESC, review_id DESC) = 1), o AS (SELECT venue_id, max(published) AS ordinary FROM p WHERE phrase IS NULL GROUP BY 1)
SELECT n.venue_id, phrase IS NOT NULL AS closed, CASE WHEN phrase IS NOT NULL AND coalesce(published - ordinary <= INTERVAL 90 DAY, false) THEN 'low' ELSE 'high' END AS confidence, CASE WHEN phrase IS NOT NULL THEN published END AS evidence, phrase FROM n LEFT JOIN o USING (venue_id)""")
def closure_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.closure_signals(S.review(spark, sf_dir), PHRASES, NEGATIONS)


@query(S.sql("review") + """, r AS (SELECT *, row_number() OVER (PARTITION BY venue_id, md5(text) ORDER BY published DESC NULLS LAST, review_id) AS copy FROM review), n AS (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY published DESC NULLS LAST, review_id) AS place, count(*) OVER (PARTITION BY venue_id) AS all_ FROM r WHERE copy = 1)
SELECT venue_id, count(*) AS kept, min(published) AS oldest, max(published) AS newest, max(all_) > 4 AS truncated FROM n WHERE place <= 4 GROUP BY 1""")
def review_merge_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest four different reviews of a venue (the cap is the serving slice)."""
    rows = S.review(spark, sf_dir).select("venue_id", "review_id", "published", F.md5("text").alias("h"))
    order = [F.desc_nulls_last("published"), F.asc("review_id")]
    once = places.first_by(rows, ["venue_id", "h"], *order)
    w = Window.partitionBy("venue_id")
    ranked = once.withColumns({"place": F.row_number().over(w.orderBy(*order)), "n": F.count("*").over(w)})
    return ranked.where("place <= 4").groupBy("venue_id").agg(F.count("*").alias("kept"), F.min("published").alias("oldest"), F.max("published").alias("newest"), (F.max("n") > 4).alias("truncated"))


@query(S.sql("item") + """, d AS (SELECT o_custkey AS post, month(o_orderdate) AS month, year(o_orderdate) AS year, o_orderkey % 3 = 0 AS inferred FROM orders), n AS (SELECT post, month, year, count(*) AS n, bool_or(NOT inferred) AS stated FROM d GROUP BY ALL),
b AS (SELECT * FROM n QUALIFY n = max(n) OVER (PARTITION BY post, month)) SELECT post, month::INT AS month, CASE WHEN count(*) = 1 THEN min(year) WHEN count_if(stated) = 1 THEN min(year) FILTER (stated) END::INT AS year FROM b GROUP BY 1, 2""")
def sibling_year_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = S.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("post"), F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year"), (F.col("o_orderkey") % 3 == 0).alias("inferred"))
    return happenings.sibling_years(d)


@query(S.sql("engagement") + "SELECT user_id, venue_id, (ts - INTERVAL 3 HOUR)::DATE AS day, min(struct_pack(ts := ts, e := event_id)).e AS event_id FROM engagement WHERE event_type = 'click' GROUP BY 1, 2, 3")
def like_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engagement.likes(S.engagement(spark, sf_dir))


@query("SELECT count(DISTINCT user_id) AS total, " + ", ".join(f"count(DISTINCT user_id) FILTER (day <= t AND t - day < {n}) AS d{n}" for n in (1, 7, 30)) + f" FROM (SELECT user_id, (ts - INTERVAL 3 HOUR)::DATE AS day, (TIMESTAMP '{S.AS_OF}' - INTERVAL 3 HOUR)::DATE AS t FROM events)")
def activity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engagement.activity(S.engagement(spark, sf_dir), S.AS_OF)


@query(S.sql("engagement") + "SELECT month, venue_id, row_number() OVER (PARTITION BY month ORDER BY f, venue_id)::INT AS place, row_number() OVER (PARTITION BY month ORDER BY f, venue_id) <= 300 AS within FROM (SELECT date_trunc('month', ts - INTERVAL 3 HOUR)::DATE AS month, venue_id, min(struct_pack(ts := ts, e := event_id)) AS f FROM engagement GROUP BY 1, 2)")
def monthly_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engagement.ledger(S.engagement(spark, sf_dir), 300)


@query(S.sql("engagement") + """, g AS (SELECT venue_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 48 HOUR THEN 0 ELSE 1 END AS new FROM engagement WHERE event_type = 'click' WINDOW w AS (PARTITION BY venue_id ORDER BY ts)),
s AS (SELECT venue_id, ts, sum(new) OVER (PARTITION BY venue_id ORDER BY ts) AS n FROM g) SELECT venue_id, min(ts) AS started, max(ts) + INTERVAL 48 HOUR AS ended, count(*) AS likes FROM s GROUP BY venue_id, n""")
def hot_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engagement.hot_sessions(S.engagement(spark, sf_dir).where("event_type = 'click'"), 48)


@query(S.sql("venue", "rating") + "SELECT venue_id, coalesce(d.rating, b.rating) AS rating, CASE WHEN d.venue_id IS NULL THEN 1 ELSE 2 END AS version FROM (SELECT venue_id, rating FROM rating) b FULL JOIN (SELECT venue_id, k / 10.0 AS rating FROM venue WHERE k % 4 = 0) d USING (venue_id)")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = S.rating(spark, sf_dir).select("venue_id", "rating", F.lit(1).alias("version"))
    delta = S.venue(spark, sf_dir).where("k % 4 = 0").select("venue_id", (F.col("k") / 10).alias("rating"), F.lit(2).alias("version"))
    return places.keyed_latest(base, delta, ["venue_id"], "version")


@query(S.sql("venue", "rating", "live") + f", {DECIDED} SELECT venue_id, category, rating, reviews, busyness FROM decided LEFT JOIN rating USING (venue_id) LEFT JOIN live USING (venue_id) WHERE lifecycle = 'active' AND (why IS NULL OR sure = 'low') AND {INSIDE}")
def serving_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.servable(S.venue(spark, sf_dir), RULES, _good(), CIRCLES).withColumn("category", E.category(F.col("gtype"), F.col("btype"), GOOGLE_MAP, CROWD_MAP))
    return rows.join(S.rating(spark, sf_dir), "venue_id", "left").join(S.live(spark, sf_dir), "venue_id", "left").select("venue_id", "category", "rating", "reviews", "busyness")


@query(S.sql("venue") + f", {DECIDED} SELECT venue_id FROM decided WHERE NOT coalesce(lifecycle = 'active' AND (why IS NULL OR sure = 'low') AND {INSIDE}, false)")
def removed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = S.venue(spark, sf_dir).select("venue_id")
    return known.join(E.servable(S.venue(spark, sf_dir), RULES, _good(), CIRCLES).select("venue_id"), "venue_id", "left_anti")


@query(S.sql("rating") + ", b AS (SELECT 'v' || l_partkey AS venue_id, round(avg(l_quantity), 4) AS rating, count(*) AS reviews FROM lineitem WHERE l_orderkey % 50 <> 0 GROUP BY 1) SELECT venue_id, CASE WHEN b.venue_id IS NULL THEN 'left' WHEN r.venue_id IS NULL THEN 'entered' ELSE 'changed' END AS change FROM rating r FULL JOIN b USING (venue_id) WHERE b.venue_id IS NULL OR r.venue_id IS NULL OR r.reviews <> b.reviews OR abs(r.rating - b.rating) > 1e-9")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = S.rating(spark, sf_dir)
    lines = S.read(spark, sf_dir, "lineitem").where("l_orderkey % 50 <> 0")
    b = lines.groupBy(F.concat(F.lit("v"), "l_partkey").alias("venue_id")).agg(F.round(F.avg("l_quantity"), 4).alias("rating_b"), F.count("*").alias("reviews_b"))
    change = F.when(F.col("reviews_b").isNull(), "left").when(F.col("reviews").isNull(), "entered").when((F.col("reviews") != F.col("reviews_b")) | (F.abs(F.col("rating") - F.col("rating_b")) > 1e-9), "changed")
    return a.join(b, "venue_id", "full").select("venue_id", change.alias("change")).where("change IS NOT NULL")


@query("SELECT event_type AS dataset, strftime(ts, '%Y-%m-%d') AS dt, strftime(ts, '%H') AS hour, strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d') AS local_date, count(*) AS n FROM events GROUP BY ALL")
def lake_hourly_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = S.read(spark, sf_dir, "events")
    rows = lake.envelope(e, "events", "app", F.struct("event_type", "props"))
    return rows.groupBy(F.col("payload.event_type").alias("dataset"), "dt", "hour", "local_date").agg(F.count("*").alias("n"))


@query("SELECT event_id, 2 AS n_params, CASE WHEN event_id % 2 = 0 THEN '***REDACTED***' ELSE 'u' || user_id END AS who FROM events")
def redacted_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.when(F.col("event_id") % 2 == 0, F.lit("pri_0123456789abcdef0")).otherwise(F.concat(F.lit("u"), "user_id"))
    params = F.create_map(F.lit("API_KEY"), F.lit("x"), F.lit("who"), who, F.lit("k"), F.get_json_object("props", "$.k"), F.lit("token"), F.lit("t"))
    out = S.read(spark, sf_dir, "events").select("event_id", text.redact(params).alias("p"))
    return out.select("event_id", F.size("p").alias("n_params"), F.col("p")["who"].alias("who"))


@query("SELECT event_id FROM events WHERE (props->>'$.k')::INT >= 50 AND TIMESTAMP '2024-01-31' - ts <= INTERVAL 30 DAY OR (props->>'$.k')::INT < 50 AND TIMESTAMP '2024-01-31' - ts <= INTERVAL 7 DAY")
def fresh_ids_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A status from JSON decides how long a row is fresh: 30 days or 7."""
    found = F.get_json_object("props", "$.k").cast("int") >= 50
    age = dates.micros(F.lit(S.AS_OF)) - dates.micros(F.col("ts"))
    return S.read(spark, sf_dir, "events").where(age <= F.when(found, 30).otherwise(7) * F.lit(86_400_000_000)).select("event_id")


@query(S.sql("source") + "SELECT event_id, max_by(source_id, struct_pack(n := n_images, l := -line)) AS source_id, max(n_images) AS n_images FROM source GROUP BY 1")
def dedupe_by_key_richest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.post_source(spark, sf_dir).select("event_id", "source_id", "n_images", "line")
    return happenings.richest(rows, ["event_id"]).select("event_id", "source_id", "n_images")


def _hmac(key: bytes, x: str) -> str:
    inner, outer = ("".join(f"\\x{b ^ pad:02X}" for b in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    return f"sha256('{outer}'::BLOB || unhex(sha256('{inner}'::BLOB || encode({x}))))"


@query(f"SELECT DISTINCT user_id, {_hmac(b'key', 'user_id::VARCHAR')} AS pseudonym FROM events")
def user_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH-02."""
    users = S.read(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", text.hmac_sha256("key", F.col("user_id").cast("string")).alias("pseudonym"))
