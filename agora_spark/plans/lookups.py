"""Named queries of small rules: shared line-ups, look-ups around a point, tiers of candidates, labels of profiles, cursors of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora_spark.operators import happenings, places, posts
from agora_spark.operators import resolution as R
from agora_spark.operators import runs
from agora_spark.plans.catalog import GENERIC, JUDGED, STOP, WORDS, _km, query
from agora_spark.sources import lake
from agora_spark.sources import standins as S


@query(S.sql("item", "source") + WORDS + JUDGED + """, lined AS (SELECT DISTINCT event_id, 'n' || (part % 60) AS name FROM source), act AS (SELECT event_id, venue, starts_at, local, name FROM words JOIN lined USING (event_id)),
shared AS (SELECT a.venue, a.event_id, b.event_id AS other_event_id, count(*) AS shared FROM act a JOIN act b ON a.venue = b.venue AND a.name = b.name AND a.event_id < b.event_id AND (a.local::DATE = b.local::DATE OR abs(epoch(a.starts_at) - epoch(b.starts_at)) <= 8 * 3600) GROUP BY ALL HAVING count(*) >= 2)
SELECT venue, event_id, other_event_id, CASE WHEN shared IS NOT NULL OR band = 'auto' THEN 'auto' ELSE 'suggest' END AS band, concat_ws(',', CASE WHEN shared IS NOT NULL THEN 'lineup' END, CASE WHEN shared IS NULL OR band = 'auto' THEN 'title' END) AS reasons, coalesce(shared, 0) AS shared FROM judged FULL JOIN shared USING (venue, event_id, other_event_id)""")
def lineup_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-04: pairs of events by their titles, raised by a line-up that they share."""
    lined = S.post_source(spark, sf_dir).select("event_id", F.concat(F.lit("n"), F.col("part") % 60).alias("name"))
    return runs.raised_pairs(happenings.worded(S.post_item(spark, sf_dir), GENERIC, STOP), lined)


ASKED = "asked AS (SELECT k AS request, CASE k % 4 WHEN 0 THEN left(name, 3) WHEN 1 THEN upper(name) WHEN 2 THEN name || ', Pina' ELSE 'x' || name END AS name, lat + 0.0004 AS lat, lng - 0.0003 AS lng FROM venue WHERE k % 3 = 0)"


@query(S.sql("venue") + f", {ASKED}, f AS (SELECT request, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS f, lat, lng FROM asked), v AS (SELECT venue_id, trim(lower(name)) AS f, lat, lng FROM venue WHERE lifecycle = 'active' AND trim(name) <> '') SELECT request, min(struct_pack(km := round({_km('f.lat', 'f.lng', 'v.lat', 'v.lng')}, 9), id := v.venue_id)).id AS venue_id FROM f JOIN v ON (contains(v.f, f.f) OR contains(f.f, v.f)) AND {_km('f.lat', 'f.lng', 'v.lat', 'v.lng')} <= 0.15 GROUP BY 1")
def geo_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-18: venues that are already there, looked up around a point; short names count, too."""
    k, v = F.col("k"), S.venue(spark, sf_dir)
    name = F.when(k % 4 == 0, F.left("name", F.lit(3))).when(k % 4 == 1, F.upper("name")).when(k % 4 == 2, F.concat("name", F.lit(", Pina"))).otherwise(F.concat(F.lit("x"), "name"))
    return R.geo_lookups(v.where("k % 3 = 0").select(k.alias("request"), name.alias("name"), (F.col("lat") + 0.0004).alias("lat"), (F.col("lng") - 0.0003).alias("lng")), v)


TIERS = "tier AS (SELECT venue_id, k, lifecycle, CASE WHEN k % 7 < 2 THEN 'evidence_confirmed' WHEN k % 7 < 4 THEN 'category_candidate' WHEN k % 7 = 4 THEN 'rejected' END AS tier FROM venue)"


@query(S.sql("venue") + f", {TIERS} SELECT wide, venue_id, place FROM (SELECT wide, venue_id, row_number() OVER (PARTITION BY wide ORDER BY venue_id)::INT AS place FROM tier, (VALUES (false), (true)) w(wide) WHERE lifecycle = 'active' AND (tier = 'evidence_confirmed' OR wide AND tier = 'category_candidate')) WHERE place <= 500")
def tier_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-36, and mode 4 of FLT-29: the first venues (the run's size) of the tiers that a run is for, in order of their ids."""
    k = F.col("k")
    tier = F.when(k % 7 < 2, "evidence_confirmed").when(k % 7 < 4, "category_candidate").when(k % 7 == 4, "rejected")
    venues, out = S.venue(spark, sf_dir).withColumn("tier", tier), None
    for wide in (False, True):
        rows = posts.tier_candidates(venues.where("lifecycle = 'active'"), ["evidence_confirmed", *(["category_candidate"] if wide else [])], 500).withColumn("wide", F.lit(wide))
        out = rows if out is None else out.unionByName(rows)
    return out.select("wide", "venue_id", "place")


# The categories of labels of a vibe profile.
CATEGORIES = ("publico", "musica", "music_format", "estilo_do_lugar", "estetica", "intencao", "dress_code", "clima_social")


@query(S.sql("venue") + f", c AS (SELECT venue_id, k, unnest(range(8)) AS i FROM venue WHERE k % 3 <> 2), l AS (SELECT venue_id, k, i, CASE WHEN (k + i) % 4 = 0 THEN [] WHEN (k + i) % 4 = 1 THEN ['l' || (k % 9)] ELSE ['l' || (k % 9), 'm' || (i * k % 5)] END AS labels FROM c) SELECT venue_id, string_agg({str(list(CATEGORIES))}[i + 1] || '=' || array_to_string(labels, '|'), ';' ORDER BY i) AS labels, sum(len(labels))::BIGINT AS n FROM l GROUP BY 1")
def profile_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ARR-08: all labels of a profile by category; categories without labels are there, too."""
    k = F.col("k")

    def labels(i: int):
        first, second = F.concat(F.lit("l"), k % 9), F.concat(F.lit("m"), (k * i) % 5)
        return F.when((k + i) % 4 == 0, F.array().cast("array<string>")).when((k + i) % 4 == 1, F.array(first)).otherwise(F.array(first, second))

    profile = F.to_json(F.struct(*(F.struct(F.when((k + i) % 4 != 0, labels(i)).alias("labels"), F.lit(0.5).alias("confidence")).alias(c) for i, c in enumerate(CATEGORIES))))
    rows = S.venue(spark, sf_dir).where("k % 3 <> 2").select("venue_id", profile.alias("profile")).withColumn("all", posts.all_labels(F.col("profile"), list(CATEGORIES)))
    said = F.array_join(F.transform(F.map_entries("all"), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], "|"))), ";")
    return rows.select("venue_id", said.alias("labels"), F.aggregate(F.map_values("all"), F.lit(0), lambda a, v: a + F.size(v)).cast("long").alias("n"))


@query(S.sql("venue", "review") + f", newest AS (SELECT venue_id, max(published) AS newest FROM review GROUP BY 1) SELECT venue_id, strftime(greatest(TIMESTAMP '{S.AS_OF}' - INTERVAL 180 DAY, coalesce(newest, TIMESTAMP '1970-01-01')), '%Y-%m-%dT%H:%M:%SZ') AS since FROM venue LEFT JOIN newest USING (venue_id)")
def review_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ-13: where the next fetch of a venue's reviews begins: at its newest stored review, but not before the window."""
    newest = S.review(spark, sf_dir).groupBy("venue_id").agg(F.max("published").alias("newest"))
    since = posts.fetch_since(F.col("newest"), F.lit(S.AS_OF).cast("timestamp"), 180)
    return S.venue(spark, sf_dir).select("venue_id").join(newest, "venue_id", "left").select("venue_id", F.date_format(since, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("since"))


@query(S.sql("venue") + """, base AS (SELECT venue_id, unnest(range(3)) AS day, k FROM venue WHERE k % 4 <> 0), b AS (SELECT venue_id, day, 'p' || k AS payload, 't' || (k % 5) AS kind, k % 2 = 0 AS locked FROM base),
d AS (SELECT venue_id, day, 'n' || k AS payload, CASE WHEN k % 5 <> 0 THEN 'u' || (k % 7) END AS kind, k % 3 = 0 AS locked, k FROM (SELECT venue_id, k, unnest(range(1, 4)) AS day FROM venue WHERE k % 3 <> 0))
SELECT coalesce(d.venue_id, b.venue_id) AS venue_id, coalesce(d.day, b.day)::INT AS day, coalesce(d.payload, b.payload) AS payload, CASE WHEN d.k % 2 = 0 THEN d.kind ELSE b.kind END AS kind, CASE WHEN d.k % 4 < 2 THEN d.locked WHEN b.venue_id IS NOT NULL THEN b.locked ELSE false END AS locked FROM b FULL JOIN d ON b.venue_id = d.venue_id AND b.day = d.day""")
def enrichment_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-07 and SNK-08: rows of a composite key; what a caller does not give of the promoted columns stays, or is the default."""
    k, v = F.col("k"), S.venue(spark, sf_dir)
    days = lambda a, b: v.select("venue_id", "k", F.explode(F.sequence(F.lit(a), F.lit(b))).alias("day"))
    base = days(0, 2).where("k % 4 <> 0").select("venue_id", "day", F.concat(F.lit("p"), k).alias("payload"), F.concat(F.lit("t"), k % 5).alias("kind"), (k % 2 == 0).alias("locked"))
    given = F.array_compact(F.array(F.when(k % 2 == 0, "kind"), F.when(k % 4 < 2, "locked")))
    delta = days(1, 3).where("k % 3 <> 0").select("venue_id", "day", F.concat(F.lit("n"), k).alias("payload"), F.when(k % 5 != 0, F.concat(F.lit("u"), k % 7)).alias("kind"), (k % 3 == 0).alias("locked"), given.alias("given"))
    return places.upsert_given(base, delta, ["venue_id", "day"], ["payload"], {"kind": F.lit(None).cast("string"), "locked": F.lit(False)})


@query("""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS ingested_at_utc, strftime(ts - INTERVAL 3 HOUR, '%Y-%m-%d') AS recife_date, hour(ts - INTERVAL 3 HOUR)::INT AS recife_hour, CASE WHEN event_id % 5 = 0 THEN 'error' ELSE 'success' END AS outcome, CASE WHEN event_id % 5 = 0 THEN 500 ELSE 200 END AS http_status, 'v' || user_id AS venue_id, CASE WHEN event_id % 2 = 0 THEN '***REDACTED***' ELSE 'u' || user_id END AS who, event_id::VARCHAR AS record_id, CASE WHEN event_id % 5 = 0 THEN 'timeout' END AS error FROM events""")
def lake_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK-02: the fields of a record that depend on the event."""
    k = F.col("event_id")
    failed = k % 5 == 0
    params = F.create_map(F.lit("token"), F.lit("x"), F.lit("who"), F.when(k % 2 == 0, "pub_0123456789abcdef0").otherwise(F.concat(F.lit("u"), "user_id")))
    rows = lake.record(S.read(spark, sf_dir, "events"), "events", "app", F.col("props"), F.col("ts"), params, k.cast("string"), outcome=F.when(failed, "error").otherwise("success"), http_status=F.when(failed, 500).otherwise(200), venue_id=F.concat(F.lit("v"), "user_id"), error=F.when(failed, "timeout"))
    return rows.select("ingested_at_utc", "recife_date", "recife_hour", "outcome", "http_status", "venue_id", F.col("request")["who"].alias("who"), "record_id", "error")


@query("""SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN event_id % 3 // 2 + 1 END::INT AS schema_version, CASE WHEN event_id % 97 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 97 <> 0 AND event_id % 89 <> 0 THEN round(value, 6) END AS amount, CASE WHEN event_id % 97 <> 0 THEN (event_id % 7)::VARCHAR END AS extra, CASE WHEN event_id % 97 = 0 THEN 'line' WHEN event_id % 89 = 0 THEN 'amount' END AS bad FROM events""")
def lake_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of two versions read as one: the older ones have all in their payload, newer ones have columns promoted; bad ones are kept and named."""
    k, amount = F.col("event_id"), F.when(F.col("event_id") % 89 == 0, "much").otherwise(F.col("value").cast("string"))
    extra = (k % 7).cast("string").alias("extra")
    old = F.struct(F.lit(1).alias("schema_version"), F.struct(F.col("event_type").alias("type"), amount.alias("amount"), extra).alias("payload"))
    new = F.struct(F.lit(2).alias("schema_version"), F.col("event_type").alias("kind"), amount.alias("amount"), F.struct(extra).alias("payload"))
    line = F.when(k % 3 == 2, F.to_json(new)).otherwise(F.to_json(old))
    lines = S.read(spark, sf_dir, "events").select("event_id", F.when(k % 97 == 0, F.left(line, F.char_length(line) - 3)).otherwise(line).alias("value"))
    rows = lake.promoted(lines, {"kind": "string", "amount": "double"}, {"kind": "type"})
    return rows.select("event_id", "schema_version", "kind", F.round("amount", 6).alias("amount"), F.col("rest")["extra"].alias("extra"), F.array_join("bad", ",").alias("bad"))


TIER_SQL = """cand AS (SELECT venue_id, k, t, p AS place, 'h' || t || p || '_' || (k % 50) AS handle, [0.75, 0.4, 0.2][t + 1]::DOUBLE AS provenance, ['present', 'unknown', 'absent', 'present'][(k + 2 * t + p) % 4 + 1] AS found, ((k * 13 + t * 7 + p * 29) % 101) / 100.0::DOUBLE AS sim FROM venue, range(3) a(t), range(2) b(p) WHERE (k + t + p) % 5 <> 0),
plain AS (SELECT *, round(least(1.0, provenance + CASE WHEN found = 'present' THEN 0.15 ELSE 0 END + 0.4 * sim), 6) AS raw, CASE WHEN found = 'unknown' THEN 0.6 ELSE 0.75 END AS bar FROM cand WHERE found <> 'absent'),
scored AS (SELECT *, raw >= 0.45 AND raw < bar AND k % 3 <> 0 AS judged, CASE WHEN raw >= 0.45 AND raw < bar AND k % 3 <> 0 THEN round(least(CASE WHEN k % 2 = 0 THEN 0.5 + (k % 50) / 100.0 ELSE least(raw, 0.4) END, CASE WHEN k % 4 < 2 THEN 0.8 ELSE 1.0 END), 6) ELSE raw END::DOUBLE AS confidence FROM plain),
seen AS (SELECT * FROM (SELECT *, min(place) FILTER (confidence >= bar) OVER (PARTITION BY venue_id, t) AS stop FROM scored) WHERE stop IS NULL OR place <= stop),
tier_best AS (SELECT venue_id, t, min(struct_pack(m := -confidence, t := t, p := place, h := handle, b := bar)) AS m FROM seen GROUP BY ALL),
run AS (SELECT venue_id, t, min(m) OVER (PARTITION BY venue_id ORDER BY t) AS m FROM tier_best), stops AS (SELECT venue_id, min(t) AS stop FROM run WHERE -m.m >= m.b GROUP BY 1),
last AS (SELECT r.venue_id, arg_max(m, r.t) AS m FROM run r LEFT JOIN stops s USING (venue_id) WHERE stop IS NULL OR r.t <= stop GROUP BY 1)"""


def _cascade(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k, venues = F.col("k"), S.venue(spark, sf_dir).select("venue_id", "k")
    tiers = []
    for t, provenance in enumerate((0.75, 0.4, 0.2)):
        p = F.col("place")
        rows = venues.withColumn("place", F.explode(F.array(F.lit(0), F.lit(1)))).where((k + t + p) % 5 != 0)
        found = F.get(F.array(*map(F.lit, ("present", "unknown", "absent", "present"))), ((k + 2 * t + p) % 4).cast("int"))
        tiers.append(rows.select("venue_id", "place", F.concat(F.lit(f"h{t}"), p, F.lit("_"), k % 50).alias("handle"), F.lit(provenance).alias("provenance"), found.alias("exists"), ((k * 13 + t * 7 + p * 29) % 101 / 100).alias("similarity")))
    said = None
    for tier in tiers:
        rows = tier.join(venues, "venue_id").where("k % 3 <> 0").select("venue_id", "handle", (k % 2 == 0).alias("match"), (0.5 + k % 50 / 100).alias("confidence"), F.when(k % 4 < 2, "text_only").otherwise("multimodal").alias("mode"))
        said = rows if said is None else said.unionByName(rows)
    return R.cascade(venues, tiers, said)


@query(S.sql("venue") + f", {TIER_SQL} SELECT venue_id, m.h AS handle, m.t::INT AS tier, -m.m AS confidence, CASE WHEN -m.m >= m.b THEN 'found' WHEN -m.m >= 0.5 THEN 'low_confidence' ELSE 'not_found' END AS status FROM venue LEFT JOIN last USING (venue_id)")
def judged_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CMP-02 with its judge: tiers of candidates in order of cost, each only for venues that are still open."""
    return _cascade(spark, sf_dir)[0]


@query(S.sql("venue") + f", {TIER_SQL} SELECT t::INT AS tier, (SELECT count(*) FROM venue LEFT JOIN stops USING (venue_id) WHERE stop IS NULL OR stop >= t) AS asked, (SELECT count(*) FROM seen LEFT JOIN stops USING (venue_id) WHERE seen.t = a.t AND (stops.stop IS NULL OR stops.stop >= a.t)) AS candidates, (SELECT count(*) FROM seen LEFT JOIN stops USING (venue_id) WHERE judged AND seen.t = a.t AND (stops.stop IS NULL OR stops.stop >= a.t)) AS judged, (SELECT count(*) FROM stops WHERE stop = a.t) AS settled FROM range(3) a(t)")
def cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many venues each tier was asked for, how many candidates it brought and had judged, and how many it settled."""
    return _cascade(spark, sf_dir)[1]
