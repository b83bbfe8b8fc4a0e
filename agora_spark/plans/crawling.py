"""Named queries on crawls and their posts, photos, reviews, budgets and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agora_spark.functions import dates, rules, text
from agora_spark.operators import eligibility as E
from agora_spark.operators import places
from agora_spark.operators import posts as P
from agora_spark.plans.catalog import CATEGORY, CIRCLES, CROWD_MAP, DECIDED, GOOGLE_MAP, INSIDE, PRICED, RULES, TOP, _good, _priced, _top, query
from agora_spark.sources import standins as S

LOOKBACKS = ("3 months", "10 Days", "1 year", "soon")


def _now() -> Column:
    return F.lit(S.AS_OF).cast("timestamp")


# Crawl targets stand for customers, their posts for events of users.
TARGET = f"""target AS (SELECT c_custkey AS target, CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours((c_custkey % 600)::INT) END AS cursor, [{', '.join(f"'{x}'" for x in LOOKBACKS)}][c_custkey % 4 + 1] AS lookback, c_custkey % 5 <> 0 AS ok FROM customer),
bound AS (SELECT *, CASE WHEN cursor IS NOT NULL THEN cursor - INTERVAL 6 HOUR WHEN lookback = '3 months' THEN TIMESTAMP '{S.AS_OF}' - INTERVAL 90 DAY WHEN lookback = '10 Days' THEN TIMESTAMP '{S.AS_OF}' - INTERVAL 10 DAY WHEN lookback = '1 year' THEN TIMESTAMP '{S.AS_OF}' - INTERVAL 365 DAY END AS cutoff FROM target),
post AS (SELECT event_id, user_id % 60 AS target, CASE WHEN event_id % 19 <> 0 THEN ts END AS published, event_id % 3 = 0 AS pinned FROM events),
kept AS (SELECT post.*, NOT coalesce(pinned AND published < cutoff, false) AS kept FROM post LEFT JOIN bound USING (target))"""


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    cursor = F.when(k % 3 != 0, F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(k % 600).cast("int")))
    lookback = F.get(F.array(*map(F.lit, LOOKBACKS)), (k % 4).cast("int"))
    rows = S.read(spark, sf_dir, "customer").select(k.alias("target"), cursor.alias("cursor"), lookback.alias("lookback"), (k % 5 != 0).alias("ok"))
    return rows.withColumn("cutoff", P.cutoff(F.col("cursor"), 6, F.col("lookback"), _now()))


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return S.read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 60).alias("target"), F.when(k % 19 != 0, F.col("ts").cast("timestamp")).alias("published"), (k % 3 == 0).alias("pinned"))


@query(f"WITH {TARGET} SELECT target, epoch_us(cutoff) AS cutoff_us FROM bound")
def crawl_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each stream's fetch begins."""
    return _targets(spark, sf_dir).select("target", dates.micros(F.col("cutoff")).alias("cutoff_us"))


@query(f"WITH {TARGET} SELECT event_id, target, kept FROM kept")
def pinned_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old pinned posts go."""
    return P.kept_posts(_posts(spark, sf_dir), _targets(spark, sf_dir), "target").select("event_id", "target", "kept")


@query(f"WITH {TARGET} SELECT target, epoch_us(CASE WHEN ok THEN greatest(cursor, newest) ELSE cursor END) AS cursor_us FROM target LEFT JOIN (SELECT target, max(published) AS newest FROM kept WHERE kept GROUP BY 1) USING (target)")
def cursor_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors move to the newest post that was kept, where the run went well."""
    targets = _targets(spark, sf_dir)
    out = P.advanced(targets, P.kept_posts(_posts(spark, sf_dir), targets, "target"), "target")
    return out.select("target", dates.micros(F.col("cursor")).alias("cursor_us"))


@query("SELECT c_custkey AS target, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 3 * 10 WHEN c_custkey % 4 <> 0 THEN c_custkey % 4 * 7 ELSE 200 END AS reels_seed, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 4 * 7 ELSE 200 END AS posts_seed FROM customer")
def results_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's limit: its own, else that of posts, else the default; 0 is none."""
    k = F.col("c_custkey")
    reels, posts = k % 3 * 10, F.when(k % 8 != 0, k % 4 * 7)
    return S.read(spark, sf_dir, "customer").select(k.alias("target"), P.first_set(reels, posts, F.lit(200)).alias("reels_seed"), P.first_set(posts, F.lit(200)).alias("posts_seed"))


@query("SELECT c_custkey AS target, CASE WHEN c_custkey % 2 = 0 THEN 'disabled' WHEN c_custkey % 3 = 0 THEN 'seeded' END AS reels_skipped, c_custkey % 5 = 0 AND c_custkey % 7 <> 0 AS never_seeded, c_custkey % 4 = 1 AND c_custkey % 5 = 0 AND c_custkey % 3 = 0 AS dormant FROM customer")
def crawl_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why reels are skipped, which targets never got a cursor though they ran, and which answer with nothing."""
    k = F.col("c_custkey")
    rows = S.read(spark, sf_dir, "customer").select(k.alias("target"), (k % 2 != 0).alias("crawl_reels"), F.when(k % 3 == 0, k).alias("reels_seeded_at"), F.when(k % 5 != 0, k).alias("cursor"), F.when(k % 7 != 0, k).alias("last_run"), F.when(k % 4 == 1, "no_items").when(k % 4 == 2, "not_found").alias("error"), (k % 3).alias("blocked"))
    skipped = F.when(~F.col("crawl_reels"), "disabled").when(F.col("reels_seeded_at").isNotNull(), "seeded")
    dormant = F.coalesce(F.col("error") == "no_items", F.lit(False)) & (F.col("blocked") == 0) & F.col("cursor").isNull()
    return rows.select("target", skipped.alias("reels_skipped"), (F.col("cursor").isNull() & F.col("last_run").isNotNull()).alias("never_seeded"), dormant.alias("dormant"))


PHOTO = """photo AS (SELECT CASE WHEN l_orderkey % 11 <> 0 THEN 's' || (l_orderkey % 300) END AS shortcode, strftime(l_shipdate, '%Y-%m-%d') AS run, l_linenumber * 1000000 + l_partkey AS pos, 'p' || l_orderkey || '-' || l_partkey AS photo_key, CASE WHEN l_partkey % 4 = 0 THEN 'dia 12/05 ingressos' ELSE 'c' || l_partkey END AS caption,
  CASE l_partkey % 3 WHEN 0 THEN 'flyer' WHEN 1 THEN 'food' END AS category, CASE WHEN l_partkey % 5 <> 0 THEN (l_partkey % 10) / 10.0::DOUBLE END AS confidence, l_orderkey % 40 AS venue, l_linenumber * 1000 AS bytes, CASE WHEN l_partkey % 2 = 0 THEN 'owner' END AS authorship FROM lineitem),
bucket AS (SELECT shortcode, arg_min(caption, o) AS caption, arg_min(photo_key, o) AS any_key, max(run) AS run, count(*) AS photos, arg_min(photo_key, struct_pack(m := -coalesce(confidence, 0), o := o)) FILTER (category = 'flyer') AS flyer_key, first(confidence ORDER BY -coalesce(confidence, 0), o) FILTER (category = 'flyer') AS flyer_confidence
  FROM (SELECT *, struct_pack(r := run, a := pos, k := photo_key) AS o FROM photo) WHERE shortcode IS NOT NULL GROUP BY 1)"""


def _photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    return S.read(spark, sf_dir, "lineitem").select(
        F.when(k % 11 != 0, F.concat(F.lit("s"), k % 300)).alias("shortcode"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("run"), (F.col("l_linenumber").cast("long") * 1_000_000 + p).alias("at"), F.concat(F.lit("p"), k, F.lit("-"), p).alias("photo_key"), F.when(p % 4 == 0, "dia 12/05 ingressos").otherwise(F.concat(F.lit("c"), p)).alias("caption"),
        F.when(p % 3 == 0, "flyer").when(p % 3 == 1, "food").alias("category"), F.when(p % 5 != 0, (p % 10) / 10).alias("confidence"), (k % 40).alias("venue"), (F.col("l_linenumber") * 1000).cast("long").alias("bytes"), F.when(p % 2 == 0, "owner").alias("authorship"),
    )


@query(f"WITH {PHOTO} SELECT * FROM bucket")
def photo_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of the archive, one row a shortcode."""
    return P.post_buckets(_photos(spark, sf_dir))


@query(f"WITH {PHOTO} SELECT why, count(*) AS posts FROM (SELECT CASE WHEN flyer_key IS NOT NULL AND coalesce(flyer_confidence, 0) >= 0.9 THEN 'flyer' WHEN contains(caption, '12/05') THEN 'caption' END AS why FROM bucket) GROUP BY 1")
def posts_worth_a_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = P.post_buckets(_photos(spark, sf_dir))
    why = P.qualifies(F.col("flyer_key"), F.col("flyer_confidence"), text.event_markers(F.col("caption")), 0.9)
    return buckets.groupBy(why.alias("why")).agg(F.count("*").alias("posts"))


@query(f"WITH {PHOTO} SELECT shortcode, run, count(*) AS photos FROM photo p WHERE shortcode IS NOT NULL AND run = (SELECT max(run) FROM photo q WHERE q.shortcode = p.shortcode) GROUP BY 1, 2")
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each post the entries of its last run."""
    rows = P.newest_run(_photos(spark, sf_dir).where("shortcode IS NOT NULL"), ["shortcode"])
    return rows.groupBy("shortcode", "run").agg(F.count("*").alias("photos"))


@query(f"WITH {PHOTO} SELECT run, row_number() OVER (ORDER BY run)::INT AS place, count(*) AS entries FROM photo WHERE run >= '2000-01-01' GROUP BY run")
def runs_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs from a day on, oldest first; a run is a row here, so that one task orders them."""
    from pyspark.sql import Window

    rows = _photos(spark, sf_dir).where("run >= '2000-01-01'").groupBy("run").agg(F.count("*").alias("entries"))
    return rows.select("run", F.row_number().over(Window.orderBy("run")).alias("place"), "entries")


@query(f"WITH {PHOTO}, c AS (SELECT venue, string_agg(k || '=' || n, ';' ORDER BY k) AS by_category FROM (SELECT venue, coalesce(category, 'uncategorised') AS k, count(*) AS n FROM photo GROUP BY ALL) GROUP BY 1), a AS (SELECT venue, string_agg(k || '=' || n, ';' ORDER BY k) AS by_authorship FROM (SELECT venue, coalesce(authorship, 'unknown') AS k, count(*) AS n FROM photo GROUP BY ALL) GROUP BY 1) SELECT venue, count(*) AS photos, any_value(by_category) AS by_category, any_value(by_authorship) AS by_authorship, sum(bytes)::BIGINT AS bytes, min(run) AS oldest, max(run) AS newest FROM photo JOIN c USING (venue) JOIN a USING (venue) GROUP BY 1")
def archive_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored of each venue, by category and by author."""
    rows = _photos(spark, sf_dir)

    def counts(column: str, none: str, name: str) -> DataFrame:
        n = rows.groupBy("venue", F.coalesce(column, F.lit(none)).alias("k")).agg(F.count("*").alias("n"))
        return n.groupBy("venue").agg(F.array_join(F.sort_array(F.collect_list(F.concat("k", F.lit("="), "n"))), ";").alias(name))

    total = rows.groupBy("venue").agg(F.count("*").alias("photos"), F.sum("bytes").alias("bytes"), F.min("run").alias("oldest"), F.max("run").alias("newest"))
    return total.join(counts("category", "uncategorised", "by_category"), "venue").join(counts("authorship", "unknown", "by_authorship"), "venue")


BATCH = "batch AS (SELECT k AS place, CASE WHEN k % 10 <> 0 THEN 'i' || (k * 7 % (n * 2 // 5)) ELSE '' END AS venue_id, CASE WHEN k % 9 <> 0 THEN 'n' || (k * 5 % (n // 3)) END AS name FROM venue, (SELECT count(*) AS n FROM part))"


@query("WITH RECURSIVE " + S.SQL["venue"] + f", {BATCH}" + """, known AS (SELECT row_number() OVER (ORDER BY place) AS r, place, nullif(venue_id, '') AS i, nullif(name, '') AS n FROM batch WHERE coalesce(venue_id, '') <> '' OR coalesce(name, '') <> ''),
walk(r, ids, names, won) AS (SELECT 0::BIGINT, []::VARCHAR[], []::VARCHAR[], []::BIGINT[] UNION ALL SELECT j.step, CASE WHEN ok AND i IS NOT NULL THEN list_append(ids, i) ELSE ids END, CASE WHEN ok AND n IS NOT NULL THEN list_append(names, n) ELSE names END, CASE WHEN ok THEN list_append(won, place::BIGINT) ELSE won END
  FROM (SELECT w.ids, w.names, w.won, k.r AS step, k.i, k.n, k.place, NOT coalesce(list_contains(ids, k.i), false) AND NOT coalesce(list_contains(names, k.n), false) AS ok FROM walk w JOIN known k ON k.r = w.r + 1) j)
SELECT place, venue_id, name FROM batch WHERE list_contains((SELECT won FROM walk ORDER BY r DESC LIMIT 1), place)""")
def discovered_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of a search's answer are new, in their order."""
    k = F.col("k")
    rows = S.venue(spark, sf_dir).crossJoin(F.broadcast(S.read(spark, sf_dir, "part").agg(F.count("*").alias("n"))))  # one more row
    batch = rows.select(k.alias("place"), F.when(k % 10 != 0, F.concat(F.lit("i"), k * 7 % F.floor(F.col("n") * 2 / 5))).otherwise("").alias("venue_id"), F.when(k % 9 != 0, F.concat(F.lit("n"), k * 5 % F.floor(F.col("n") / 3))).alias("name"))
    return P.discovered(batch)


@query("SELECT n_nationkey AS point, greatest(least(want, 300 - coalesce(sum(want) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0)::BIGINT AS take FROM (SELECT n_nationkey, least(greatest(n_nationkey * 13 % 60 - n_regionkey * 9, 0), 40) AS want FROM nation)")
def discovery_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many venues each discovery point may bring, one after another."""
    k = F.col("n_nationkey")
    points = S.read(spark, sf_dir, "nation").select(k.alias("point"), k.alias("place"), (F.col("n_regionkey") * 9).alias("current"), (k * 13 % 60).alias("most"))
    return P.split_budget(points, 300, 40).select("point", F.col("take").cast("long").alias("take"))


@query("SELECT n_nationkey AS run, greatest(50 - 5 - n_nationkey * 3, 0) AS budget, CASE WHEN n_regionkey = 4 THEN 'error' WHEN n_nationkey % 3 + n_regionkey % 2 > 0 THEN 'partial' ELSE 'success' END AS status, n_nationkey * 0.004::DOUBLE AS cost FROM nation")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The budget left, the status and the cost of runs."""
    k, r = F.col("n_nationkey"), F.col("n_regionkey")
    return S.read(spark, sf_dir, "nation").select(k.alias("run"), rules.budget_left(F.lit(50), F.lit(5), k * 3).alias("budget"), rules.run_status(r == 4, k % 3, F.when(r > 0, r % 2)).alias("status"), (k * F.lit(0.004)).alias("cost"))


@query(S.sql("review") + f""", r AS (SELECT venue_id, review_id, review_id % 5 AS author, published, CASE WHEN review_id % 23 = 0 THEN ' ' ELSE text END AS text, review_id % 3 = 0 AS fresh FROM review),
ok AS (SELECT *, row_number() OVER (PARTITION BY venue_id, author, published, text ORDER BY fresh, review_id) AS copy FROM r WHERE trim(coalesce(text, '')) <> '' AND (published IS NULL OR TIMESTAMP '{S.AS_OF}' - published <= INTERVAL 300 DAY)),
n AS (SELECT *, row_number() OVER (PARTITION BY venue_id ORDER BY published DESC NULLS LAST, fresh, review_id) AS place, count(*) OVER (PARTITION BY venue_id) AS n FROM ok WHERE copy = 1)
SELECT venue_id, count(*) AS kept, min(published) AS oldest, max(published) AS newest, max(n) > 6 AS truncated FROM n WHERE place <= 6 GROUP BY 1""")
def review_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored and new reviews together, within a window, once each, the newest of them."""
    rows = S.review(spark, sf_dir).select("venue_id", "review_id", (F.col("review_id") % 5).alias("author"), "published", F.when(F.col("review_id") % 23 == 0, " ").otherwise(F.col("text")).alias("text"))
    return P.review_corpus(rows.where("review_id % 3 <> 0"), rows.where("review_id % 3 = 0"), _now(), 300, 6)


@query(S.sql("venue", "review") + ", deep AS (SELECT DISTINCT venue_id FROM review WHERE review_id % 2 = 0) SELECT venue_id FROM venue WHERE (k % 6 = 0 OR gtype = 'brand#2') AND contains(lower(name), 'a') AND venue_id NOT IN (SELECT venue_id FROM deep)")
def review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named venues and those of a type, narrowed by a text and to those without a deep crawl."""
    v = S.venue(spark, sf_dir)
    deep = S.review(spark, sf_dir).where("review_id % 2 = 0").select("venue_id").distinct()
    return v.where((F.col("k") % 6 == 0) | (F.col("gtype") == "brand#2")).where(F.contains(F.lower("name"), F.lit("a"))).join(deep, "venue_id", "left_anti").select("venue_id")


@query(S.sql("venue", "rating") + f", c AS (SELECT *, {CATEGORY} AS category, CASE WHEN k % 4 = 0 THEN 'live_music' WHEN k % 9 = 0 THEN 'dancing' END AS label, (k * 7) % 5 AS matches FROM venue LEFT JOIN rating USING (venue_id)) SELECT venue_id, CASE WHEN category IN ('BAR', 'NIGHTCLUB') THEN 'category' ELSE 'label:' || label END AS reason, matches FROM c WHERE (category IN ('BAR', 'NIGHTCLUB') OR label IS NOT NULL) AND matches >= 2 ORDER BY priority, reviews DESC NULLS LAST, venue_id LIMIT 60")
def event_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category gate, evidence gate, then the most urgent."""
    k = F.col("k")
    v = S.venue(spark, sf_dir).withColumn("category", E.category(F.col("gtype"), F.col("btype"), GOOGLE_MAP, CROWD_MAP)).join(S.rating(spark, sf_dir), "venue_id", "left")
    profiles = S.venue(spark, sf_dir).select("venue_id", F.when(k % 4 == 0, F.array(F.lit("live_music"))).when(k % 9 == 0, F.array(F.lit("dancing"))).alias("labels"))
    evidence = S.venue(spark, sf_dir).select("venue_id", (k * 7 % 5).alias("matches"))
    return P.target_venues(v, profiles, evidence, ["BAR", "NIGHTCLUB"], ["live_music", "dancing"], 2, 60)


@query(S.sql("venue") + f", h AS (SELECT venue_id, k, 'h' || (k % 30) AS handle FROM venue WHERE k % 8 <> 0) SELECT venue_id, handle FROM h WHERE NOT (k % 3 = 0 AND k % 6 <> 0) AND NOT (k % 5 = 0 AND TIMESTAMP '{S.AS_OF}' - (TIMESTAMP '2024-01-01' + to_days((k % 28)::INT)) <= INTERVAL 14 DAY)")
def profile_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Venues whose profile photo is to be fetched."""
    k = F.col("k")
    rows = S.venue(spark, sf_dir).where("k % 8 <> 0").select("venue_id", "k", F.concat(F.lit("h"), k % 30).alias("handle"))
    photos = rows.where("k % 3 = 0").select("venue_id", F.upper("handle").alias("handle"), (k % 6 == 0).alias("deleted"))
    attempts = rows.where("k % 5 = 0").select("venue_id", "handle", F.lit(True).alias("failed"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=(k % 28).cast("int"))).alias("at"))
    return P.profile_photo_candidates(rows, photos, attempts, _now(), 14).select("venue_id", "handle")


@query(S.sql("venue", "rating") + f", q AS (SELECT greatest(70 - 15 - (SELECT count(*) FROM region), 0) AS k) SELECT venue_id, priority, reviews, rating FROM venue LEFT JOIN rating USING (venue_id) WHERE lifecycle = 'active' AND venue_source <> 'google_only' {TOP.replace('LIMIT 40', 'LIMIT (SELECT k FROM q)')}")
def refresh_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many of the most urgent venues as the quota leaves after the reserve and what is used."""
    left = S.read(spark, sf_dir, "region").agg(F.greatest(F.lit(70 - 15) - F.count("*"), F.lit(0)).alias("left"))
    rows = S.venue(spark, sf_dir).where("lifecycle = 'active' AND venue_source <> 'google_only'")
    top = _top(rows.join(S.rating(spark, sf_dir), "venue_id", "left"), 70 - 15)  # no more than that can be left
    placed = top.withColumn("place", F.row_number().over(Window.orderBy("priority", F.desc_nulls_last("reviews"), F.desc_nulls_last("rating"), "venue_id")))
    return placed.crossJoin(F.broadcast(left)).where("place <= left").select(*top.columns)


@query(S.sql("venue", "rating") + f", {DECIDED} SELECT venue_id, priority, reviews, rating FROM decided LEFT JOIN rating USING (venue_id) WHERE lifecycle = 'active' AND (why IS NULL OR sure = 'low') AND {INSIDE} AND category <> 'RESTAURANT' {TOP}")
def event_candidates_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most urgent venues for events; places of the map service alone count, restaurants do not."""
    rows = E.servable(S.venue(spark, sf_dir), RULES, _good(), CIRCLES)
    rows = rows.where(E.category(F.col("gtype"), F.col("btype"), GOOGLE_MAP, CROWD_MAP) != "RESTAURANT")
    return _top(rows.join(S.rating(spark, sf_dir), "venue_id", "left"), 40)


@query(S.sql("venue") + ", hit AS (SELECT venue_id, name, lifecycle FROM venue WHERE contains(lower(name), 'an') OR contains(venue_id, '11')) SELECT venue_id, name, n_all, n_active, n_deprecated, n_hit, CASE WHEN n_hit > 30 THEN 30 END AS next FROM (SELECT * FROM hit ORDER BY name, venue_id LIMIT 15 OFFSET 15), (SELECT count(*) AS n_all, count_if(lifecycle = 'active') AS n_active, count_if(lifecycle = 'deprecated') AS n_deprecated FROM venue), (SELECT count(*) AS n_hit FROM hit)")
def inventory_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a search over name and id (a page is the feature), with counts and the next page's place."""
    v = S.venue(spark, sf_dir)
    hit = F.contains(F.lower("name"), F.lit("an")) | F.contains("venue_id", F.lit("11"))
    counts = v.agg(F.count("*").alias("n_all"), F.count_if(F.col("lifecycle") == "active").alias("n_active"), F.count_if(F.col("lifecycle") == "deprecated").alias("n_deprecated"), F.count_if(hit).alias("n_hit"))
    page = v.where(hit).select("venue_id", "name").orderBy("name", "venue_id").offset(15).limit(15)
    return page.crossJoin(F.broadcast(counts)).withColumn("next", F.when(F.col("n_hit") > 30, 30))


@query(S.sql("venue") + PRICED + ", old AS (SELECT venue_id, (k % 5)::INT AS old_level, CASE WHEN k % 3 = 0 THEN 'google_range' WHEN k % 3 = 1 THEN 'besttime' END AS old_source FROM venue) SELECT venue_id, CASE WHEN old_source = 'google_range' AND old_level > 0 THEN old_level ELSE level END AS level, CASE WHEN old_source = 'google_range' AND old_level > 0 THEN old_source ELSE src END AS source FROM priced JOIN old USING (venue_id)")
def sticky_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A refresh keeps a tier that the map service gave."""
    k = F.col("k")
    kept = rules.sticky_price((k % 5).cast("int"), F.when(k % 3 == 0, "google_range").when(k % 3 == 1, "besttime"), F.col("p.level"), F.col("p.source"))
    return _priced(spark, sf_dir).withColumn("s", kept).select("venue_id", F.col("s.level").alias("level"), F.col("s.source").alias("source"))


@query(S.sql("venue") + "SELECT venue_id, CASE WHEN k % 2 = 0 THEN coalesce(CASE WHEN k % 4 = 0 THEN 1.5::DOUBLE END, lat) ELSE lat END AS lat, CASE WHEN k % 2 = 0 THEN 'Rua ' || k END AS street FROM venue")
def venue_with_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The address table's place before the venue's own, where it has one."""
    v, k = S.venue(spark, sf_dir), F.col("k")
    address = v.where("k % 2 = 0").select("venue_id", F.when(k % 4 == 0, F.lit(1.5)).alias("a_lat"), F.concat(F.lit("Rua "), k).alias("street"))
    return v.join(address, "venue_id", "left").select("venue_id", F.coalesce("a_lat", "lat").alias("lat"), "street")


@query(S.sql("venue") + "SELECT venue_id, name, CASE WHEN gtype IS NOT NULL THEN 'gtype' ELSE '' END || CASE WHEN price_min IS NOT NULL THEN ',price_min' ELSE '' END AS filled, gtype, price_min FROM venue")
def venue_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A venue as its columns and the rest as JSON, read back."""
    stored = S.venue(spark, sf_dir).select("venue_id", "name", F.to_json(F.struct("gtype", "price_min")).alias("rest"))
    back = stored.withColumn("r", F.from_json("rest", "gtype string, price_min double"))
    there = lambda c, label: F.when(F.json_object_keys("rest").isNull() | ~F.array_contains(F.json_object_keys("rest"), c), "").otherwise(label)
    return back.select("venue_id", "name", F.concat(there("gtype", "gtype"), there("price_min", ",price_min")).alias("filled"), "r.gtype", "r.price_min")


@query("SELECT event_id, CASE WHEN left_s > 0 THEN left_s END AS ttl FROM (SELECT event_id, 1209600 - floor(date_diff('microsecond', ts, TIMESTAMP '2024-01-31') / 1000000)::BIGINT AS left_s FROM events)")
def photo_ttls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long an entry may still be served of two weeks."""
    return S.read(spark, sf_dir, "events").select("event_id", P.remaining_ttl(F.col("ts"), _now(), 1_209_600).alias("ttl"))


@query("SELECT status, kind, count(*) AS n, CASE WHEN kind = 'menu' THEN count_if(last_seen >= TIMESTAMP '1998-01-01') END AS current FROM (" + S.sql("announcement") + " SELECT * FROM announcement) GROUP BY 1, 2")
def event_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by status and kind, and how many dishes are still current."""
    rows = S.announcement(spark, sf_dir).groupBy("status", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("last_seen") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("c"))
    return rows.select("status", "kind", "n", F.when(F.col("kind") == "menu", F.col("c")).alias("current"))


@query(S.sql("source") + "SELECT kind, count(DISTINCT handle) AS handles, count(*) AS sources FROM source GROUP BY 1")
def handles_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.post_source(spark, sf_dir).groupBy("kind").agg(F.count_distinct("handle").alias("handles"), F.count("*").alias("sources"))


LABELS = ("bar", "patio", "stage", "menu")


@query("SELECT event_id, CASE WHEN k < 4 AND value >= 40 THEN ['bar', 'patio', 'stage', 'menu'][k + 1] ELSE 'not_classified' END AS label, array_to_string(list_slice(list_filter(['bar', 'x', 'stage', 'menu'], lambda l: l <> 'x' AND (k % 2 = 0 OR l <> 'bar')), 1, 2), ',') AS labels, array_to_string(list_filter([CASE WHEN k % 2 = 0 THEN 'even' END, CASE WHEN k % 3 = 0 THEN 'third' END], lambda l: l IS NOT NULL), ',') AS flags FROM (SELECT event_id, value, (props->>'$.k')::INT % 6 AS k FROM events)")
def confident_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a closed vocabulary that are sure enough, lists cut to the vocabulary, and flags as labels."""
    k = F.get_json_object("props", "$.k").cast("int") % 6
    guess = F.get(F.array(*map(F.lit, LABELS)), k)
    listed = F.when(k % 2 == 0, F.array(*map(F.lit, ("bar", "x", "stage", "menu")))).otherwise(F.array(*map(F.lit, ("x", "stage", "menu"))))
    return S.read(spark, sf_dir, "events").select("event_id", rules.confident(guess, F.col("value"), list(LABELS), 40).alias("label"), F.array_join(rules.within_vocabulary(listed, list(LABELS), 2), ",").alias("labels"), F.array_join(rules.true_labels({"even": k % 2 == 0, "third": k % 3 == 0}), ",").alias("flags"))


@query("SELECT event_id, array_to_string(CASE WHEN value < 80 THEN ['unsure'] ELSE [] END || CASE WHEN k < 30 THEN ['unsure:crowd'] ELSE [] END || CASE WHEN k % 3 = 0 THEN ['quiet+loud'] ELSE [] END, '; ') AS reasons FROM (SELECT event_id, value, (props->>'$.k')::INT AS k FROM events)")
def escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a classification is to be asked for again."""
    k = F.get_json_object("props", "$.k").cast("int")
    label = lambda c, name, sure: F.struct(F.lit(c).alias("category"), name.alias("label"), sure.alias("confidence"))
    labels = F.array(label("noise", F.when(k % 3 == 0, "quiet").otherwise("calm"), F.lit(0.9)), label("noise", F.lit("loud"), F.lit(0.8)), label("crowd", F.lit("young"), k / 60))
    return S.read(spark, sf_dir, "events").select("event_id", F.array_join(rules.escalate(F.col("value") / 100, labels, [("quiet", "loud")]), "; ").alias("reasons"))


@query("SELECT p_partkey, CASE lower(trim(t)) WHEN 'economy' THEN 'Economy' WHEN 'promo' THEN 'Promo' ELSE nullif(trim(t), '') END AS category, coalesce(nullif(lower(trim(u)), ''), 'event') AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'ig' || p_partkey ELSE substr(sha256(CASE WHEN p_partkey % 3 = 1 THEN p_name ELSE 'https://x/' || p_partkey END), 1, 16) END AS photo_id FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN ' ' || upper(p_type) ELSE p_type END AS t, CASE WHEN p_partkey % 4 = 0 THEN ' ' WHEN p_partkey % 4 = 1 THEN ' Menu ' ELSE p_brand END AS u FROM part)")
def spelled_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary's spelling, kinds of posts, and ids of photos."""
    k, kind = F.col("p_partkey"), F.col("p_type")
    raw = F.when(k % 2 == 0, F.concat(F.lit(" "), F.upper(kind))).otherwise(kind)
    said = F.when(k % 4 == 0, " ").when(k % 4 == 1, " Menu ").otherwise(F.col("p_brand"))
    photo = rules.photo_id(F.when(k % 3 == 0, F.concat(F.lit("ig"), k)), F.when(k % 3 == 1, F.col("p_name")), F.concat(F.lit("https://x/"), k, F.lit("=w100")))
    return S.read(spark, sf_dir, "part").select("p_partkey", rules.canonical_spelling(raw, ["Economy", "Promo"]).alias("category"), rules.post_kind(said).alias("kind"), photo.alias("photo_id"))


# URLs of a scheme, a host, a path and a tail.
_SCHEMES, _HOSTS, _TAILS = ("https://", "http://", "", "HTTPS://www."), ("instagram.com", "Instagram.com", "www.instagram.com", "l.instagram.com", "example.org"), ("", "/", "/?igshid=1", "#a", "/reels/", "?hl=pt")
URLS = "urls AS (SELECT p_partkey, ['https://', 'http://', '', 'HTTPS://www.'][p_partkey % 4 + 1] || ['instagram.com', 'Instagram.com', 'www.instagram.com', 'l.instagram.com', 'example.org'][p_partkey // 4 % 5 + 1] || '/' || CASE WHEN p_partkey % 7 = 0 THEN 'p' WHEN p_partkey % 11 = 0 THEN '' ELSE replace(upper(p_name), ' ', '_') || '.' || p_partkey END || ['', '/', '/?igshid=1', '#a', '/reels/', '?hl=pt'][p_partkey // 20 % 6 + 1] AS url FROM part)"


@query(f"WITH {URLS}, parts AS (SELECT p_partkey, regexp_replace(lower(regexp_extract(u, '//([^/?#:]*)', 1)), '^www\\.', '') AS host, regexp_extract(u, '//[^/?#]*/+([^/?#]+)', 1) AS first FROM (SELECT p_partkey, CASE WHEN contains(url, '//') THEN url ELSE 'https://' || url END AS u FROM urls)), j AS (SELECT *, CASE WHEN host = 'l.instagram.com' THEN 'link_shim' WHEN NOT contains(host, 'instagram.com') THEN 'not_instagram' WHEN first = '' THEN 'empty' WHEN lower(first) IN ('p', 'reels') THEN 'non_profile_path' END AS rejected FROM parts) SELECT p_partkey, CASE WHEN rejected IS NULL THEN lower(first) END AS handle, rejected FROM j")
def profile_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handles out of URLs, or why there is none."""
    k = F.col("p_partkey")
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    path = F.when(k % 7 == 0, "p").when(k % 11 == 0, "").otherwise(F.concat(F.replace(F.upper("p_name"), F.lit(" "), F.lit("_")), F.lit("."), k))
    url = F.concat(pick(_SCHEMES, k % 4), pick(_HOSTS, F.floor(k / 4) % 5), F.lit("/"), path, pick(_TAILS, F.floor(k / 20) % 6))
    return S.read(spark, sf_dir, "part").withColumn("h", rules.handle_of(url)).select("p_partkey", "h.handle", "h.rejected")


@query("SELECT p_brand AS kind, count(DISTINCT p_type) AS words, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS blob FROM part GROUP BY 1")
def rule_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule rows put together to one blob a kind."""
    words = S.read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("kind")).agg(F.sort_array(F.collect_set("p_type")).alias("w"))
    return words.select("kind", F.size("w").cast("long").alias("words"), F.array_join("w", ",").alias("blob"))


@query(f"WITH {PHOTO}, s AS (SELECT venue, photo_key, CASE category WHEN 'flyer' THEN 2 WHEN 'food' THEN 1 ELSE 0 END AS urgent, coalesce(confidence, 0) AS appeal, min(pos) AS pos FROM photo GROUP BY ALL), t AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY venue ORDER BY pos, photo_key) <= 2) SELECT venue, string_agg(photo_key, ',' ORDER BY urgent DESC, appeal DESC, photo_key) AS photos FROM t GROUP BY 1")
def photo_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two photos of a venue, then by category and appeal: the cut comes first, as the serving rule has it."""
    urgent = F.when(F.col("category") == "flyer", 2).when(F.col("category") == "food", 1).otherwise(0)
    one = _photos(spark, sf_dir).groupBy("venue", "photo_key", urgent.alias("urgent"), F.coalesce("confidence", F.lit(0.0)).alias("appeal")).agg(F.min("at").alias("at"))
    two = places.first_n_by(one, ["venue"], 2, F.asc("at"), F.asc("photo_key"))
    key = F.struct((-F.col("urgent")).alias("u"), (-F.col("appeal")).alias("a"), "photo_key")
    return two.groupBy("venue").agg(F.sort_array(F.collect_list(key)).alias("p")).select("venue", F.array_join(F.transform("p", lambda x: x["photo_key"]), ",").alias("photos"))
