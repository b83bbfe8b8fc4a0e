"""Named queries that link events, mentions, handles and inventory rows to venues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora_spark.operators import likeness
from agora_spark.operators import resolution as R
from agora_spark.operators.graph import cut
from agora_spark.operators.likeness import CORE_LETTERS, COVERED, GENERIC_NAME_WORDS, HELD, LOCALITIES
from agora_spark.plans.catalog import _km, query
from agora_spark.sources import standins as S

# Events with a text about their place, the tag of a place, and a caption; venues with an address and an account of about five branches.
SPOTS = """, n AS (SELECT count(*) AS parts, greatest(1, count(*) // 5) AS accounts FROM part), spot AS (SELECT k, venue_id, name, CASE WHEN k % 3 = 0 THEN 'Rua ' || (k % 11) || ', Casa Forte' ELSE 'Av. ' || (k % 7) || ', Pina' END AS address, 'h' || (k % accounts) AS handle FROM venue, n),
told AS (SELECT o_orderkey AS event_id, 'h' || (o_custkey % accounts) AS handle, CASE o_orderkey % 6 WHEN 0 THEN 'no @spot_' || (o_orderkey % (parts + 9)) WHEN 1 THEN 'CASA FORTE' WHEN 2 THEN p_name || ' club' WHEN 3 THEN p_name WHEN 4 THEN '@h' || (o_custkey % accounts) || ' Pina' END AS location_text,
  CASE WHEN o_orderkey % 7 = 0 THEN p_name END AS tag, 'hoje com @spot_' || (o_orderkey % (parts + 7)) || CASE WHEN o_orderkey % 5 = 0 THEN ' e @spot_' || (o_orderkey % (parts + 5)) ELSE '' END AS caption FROM orders, n JOIN part ON p_partkey = o_orderkey % parts)"""
_LCS = "list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(list_filter(range(1, length(a) - i + 2), lambda n: contains(b, substr(a, i, n))), lambda n: {'n': n, 'i': -i}))))"


def _blocks(pairs: str) -> str:
    """SQL tables: alike (a, b, ratio) of the texts a and b of a table of pairs, by their matching blocks: the longest common piece, then those to its left and right."""
    cut = "instr(b, substr(a, -m.i, m.n))"
    return f"""seg(a0, b0, a, b, m) AS (SELECT a, b, a, b, {_LCS} FROM (SELECT DISTINCT a, b FROM {pairs} WHERE a <> '' AND b <> '') UNION ALL
  SELECT a0, b0, a, b, {_LCS} FROM (SELECT a0, b0, unnest([left(a, -m.i - 1), substr(a, m.n - m.i)]) AS a, unnest([left(b, {cut} - 1), substr(b, {cut} + m.n)]) AS b FROM seg WHERE m IS NOT NULL) WHERE a <> '' AND b <> ''),
alike AS (SELECT a0 AS a, b0 AS b, coalesce(2.0::DOUBLE * sum(m.n) / (length(a0) + length(b0)), 0) AS ratio FROM seg GROUP BY a0, b0)"""


def _scores(texts: str, names: str) -> str:
    """SQL tables: scored (text, name, exact) of all texts and names, tables of one column of ASCII each."""
    fold = lambda x: f"regexp_replace(lower({x}), '[^a-z0-9]', '', 'g')"
    words = ", ".join(f"'{w}'" for w in GENERIC_NAME_WORDS)
    low = "lower(name)"
    for place in LOCALITIES:
        low = f"replace({low}, '{place}', ' ')"
    held = f"length(core) >= {CORE_LETTERS} AND (contains(tw, core) OR contains(core, tw)) AND least(length(core), length(tw)) >= {COVERED} * greatest(length(core), length(tw))"
    return f"""said_t AS (SELECT text, lower(trim(text)) AS tp, {fold('text')} AS tw FROM (SELECT DISTINCT text FROM {texts} WHERE text IS NOT NULL)),
named_n AS (SELECT name, np, nw, CASE WHEN own = '' THEN nw ELSE own END AS core FROM (SELECT name, lower(trim(name)) AS np, {fold('name')} AS nw, array_to_string(list_filter(list_transform(regexp_split_to_array({low}, '[\\s\\-|,/]+'), lambda w: {fold('w')}), lambda w: w <> '' AND NOT list_contains([{words}], w)), '') AS own FROM (SELECT DISTINCT name FROM {names}))),
both_f AS MATERIALIZED (SELECT text, name, np, tp, nw, tw, core, {held} AS held FROM said_t, named_n), wanted AS (SELECT np AS a, tp AS b FROM both_f UNION SELECT nw, tw FROM both_f WHERE NOT held UNION SELECT core, tw FROM both_f WHERE NOT held),
{_blocks('wanted')},
scored AS (SELECT text, name, greatest(coalesce(p.ratio, 0), CASE WHEN nw = '' OR tw = '' THEN 0 WHEN held THEN {HELD} ELSE greatest(coalesce(w.ratio, 0), coalesce(c.ratio, 0)) END)::DOUBLE AS exact FROM both_f LEFT JOIN alike p ON p.a = np AND p.b = tp LEFT JOIN alike w ON w.a = nw AND w.b = tw LEFT JOIN alike c ON c.a = core AND c.b = tw)"""


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    address = F.when(k % 3 == 0, F.concat(F.lit("Rua "), k % 11, F.lit(", Casa Forte"))).otherwise(F.concat(F.lit("Av. "), k % 7, F.lit(", Pina")))
    return _counted(S.venue(spark, sf_dir), spark, sf_dir).select("k", "venue_id", "name", address.alias("address"), F.concat(F.lit("h"), k % F.col("accounts")).alias("handle"))


def _counted(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows with the number of parts and of accounts: one more row to join."""
    n = S.read(spark, sf_dir, "part").agg(F.count("*").alias("parts")).withColumn("accounts", F.greatest(F.lit(1), F.floor(F.col("parts") / 5)))
    return rows.crossJoin(F.broadcast(n))


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c, parts = F.col("o_orderkey"), F.col("o_custkey") % F.col("accounts"), F.col("parts")
    part = S.read(spark, sf_dir, "part").select("p_partkey", "p_name")
    text = F.when(k % 6 == 0, F.concat(F.lit("no @spot_"), k % (parts + 9))).when(k % 6 == 1, "CASA FORTE").when(k % 6 == 2, F.concat("p_name", F.lit(" club"))).when(k % 6 == 3, F.col("p_name")).when(k % 6 == 4, F.concat(F.lit("@h"), c, F.lit(" Pina")))
    caption = F.concat(F.lit("hoje com @spot_"), k % (parts + 7), F.when(k % 5 == 0, F.concat(F.lit(" e @spot_"), k % (parts + 5))).otherwise(""))
    rows = _counted(S.read(spark, sf_dir, "orders"), spark, sf_dir).withColumn("p_partkey", k % parts).join(part, "p_partkey")
    return rows.select(k.alias("event_id"), F.concat(F.lit("h"), c).alias("handle"), text.alias("location_text"), F.when(k % 7 == 0, F.col("p_name")).alias("tag"), caption.alias("caption"))


def _scored(events: DataFrame, columns: list[str], venues: DataFrame) -> list[DataFrame]:
    """For each of the columns, (event_id, venue_id, score) of the two venues whose names are most like an event's text there (ties: the smaller id). Each text is ranked once, in whichever column."""
    each = events.select(F.explode(F.array(*(F.struct(F.struct("event_id", F.lit(k).alias("of")).alias("event_id"), F.col(c).alias("text")) for k, c in enumerate(columns)))).alias("e")).select("e.*")
    said = each.where("text IS NOT NULL").select("event_id", "text", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
    places = venues.select(F.col("venue_id").alias("place"), "name", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"))
    found = likeness.ranked_links(said, places)
    return [found.where(F.col("event_id.of") == k).select("event_id.event_id", F.col("place").alias("venue_id"), "score") for k in range(len(columns))]


LINKS = """, place AS (SELECT k, venue_id AS place, CASE WHEN k % 2 = 0 THEN 'Bar ' || name ELSE name END AS name, lat, lng FROM venue), heard AS (SELECT event_id, CASE WHEN event_id % 8 = 0 THEN '@' || title ELSE title END AS text, CASE WHEN event_id % 7 = 0 THEN -8.05 + (event_id % 100) / 500.0 END::DOUBLE AS lat, CASE WHEN event_id % 7 = 0 THEN -34.9 + (event_id % 90) / 500.0 END::DOUBLE AS lng FROM item)"""


@query("WITH RECURSIVE " + S.SQL["item"] + ", " + S.SQL["venue"] + LINKS + ", clean AS (SELECT * FROM heard WHERE text NOT LIKE '@%'), " + _scores("clean", "place") + f""",
found AS (SELECT event_id, place, exact, CASE WHEN clean.lat IS NOT NULL AND place.lat IS NOT NULL THEN round({_km('clean.lat', 'clean.lng', 'place.lat', 'place.lng')}, 9) END AS km FROM clean JOIN (SELECT * FROM scored WHERE exact > 0 QUALIFY dense_rank() OVER (PARTITION BY text ORDER BY exact DESC) <= 2) USING (text) JOIN place USING (name)),
top AS (SELECT *, row_number() OVER w AS rank, round(lead(exact) OVER w, 4) AS next FROM found WINDOW w AS (PARTITION BY event_id ORDER BY exact DESC, km NULLS LAST, place) QUALIFY rank <= 2)
SELECT event_id, place, round(exact, 4) AS score, rank::INT AS rank, rank = 1 AND round(exact, 4) >= 0.55 AND (next IS NULL OR round(exact, 4) - next >= 0.08) AS linked FROM top""")
def link_candidates_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-20 and WIN-02: of all places, the two whose names are most like an event's title; points break ties."""
    k = F.col("event_id")
    title = F.when(k % 8 == 0, F.concat(F.lit("@"), "title")).otherwise(F.col("title"))
    point = lambda base, n: F.when(k % 7 == 0, F.lit(base) + (k % n) / 500.0)
    heard = S.post_item(spark, sf_dir).select("event_id", title.alias("text"), point(-8.05, 100).alias("lat"), point(-34.9, 90).alias("lng"))
    name = F.when(F.col("k") % 2 == 0, F.concat(F.lit("Bar "), "name")).otherwise(F.col("name"))
    return likeness.ranked_links(heard, S.venue(spark, sf_dir).select(F.col("venue_id").alias("place"), name.alias("name"), "lat", "lng"))


def _index(spots: DataFrame) -> DataFrame:
    return spots.select(F.concat(F.lit("spot_"), "k").alias("handle"), "venue_id")


HEARD = r""", said AS (SELECT event_id, handle AS own, 1 AS src, unnest(regexp_extract_all(lower(location_text), '(?:^|[^\w.])@([a-z0-9_.]+)', 1)) AS h, generate_subscripts(regexp_extract_all(lower(location_text), '(?:^|[^\w.])@([a-z0-9_.]+)', 1), 1) AS place FROM told WHERE location_text IS NOT NULL
UNION ALL SELECT event_id, handle, 5, unnest(regexp_extract_all(lower(caption), '(?:^|[^\w.])@([a-z0-9_.]+)', 1)), generate_subscripts(regexp_extract_all(lower(caption), '(?:^|[^\w.])@([a-z0-9_.]+)', 1), 1) FROM told),
heard AS (SELECT event_id, src, place, h, spot.venue_id FROM said LEFT JOIN spot ON 'spot_' || k = h WHERE h <> own)"""


@query(S.sql("venue") + SPOTS + HEARD + " SELECT DISTINCT event_id, src, h AS handle, venue_id FROM heard")
def known_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions in an event's own text (1) and in its caption (5), with the venue of the handle if there is one."""
    events, index = _told(spark, sf_dir), _index(_spots(spark, sf_dir))
    both = [R.heard(events, text, index).select("event_id", F.lit(k).alias("src"), "handle", "venue_id") for k, text in ((1, "location_text"), (5, "caption"))]
    return both[0].unionByName(both[1])


@query(S.sql("venue") + SPOTS + " SELECT event_id, venue_id FROM told JOIN spot USING (handle) WHERE length(location_text) >= 3 AND contains(lower(address), lower(trim(location_text))) AND (SELECT count(*) FROM spot s WHERE s.handle = told.handle) >= 2")
def neighbourhood_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches of an account whose address holds the event's text."""
    return R.neighbours(_told(spark, sf_dir), _spots(spark, sf_dir))


@query(S.sql("venue") + SPOTS + r", t AS (SELECT event_id, trim(regexp_replace(regexp_replace(location_text, '(^|[^\w.])@[A-Za-z0-9_.]{1,30}', '\1', 'g'), '\s+', ' ', 'g')) AS t FROM told) SELECT event_id, CASE WHEN regexp_matches(t, '[A-Za-z]') THEN t END AS text FROM t")
def texts_without_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(spark, sf_dir).select("event_id", R.without_handles(F.col("location_text")).alias("text"))


CLEAN = """, clean AS (SELECT event_id, trim(regexp_replace(regexp_replace(location_text, '(^|[^\\w.])@[A-Za-z0-9_.]{1,30}', '\\1', 'g'), '\\s+', ' ', 'g')) AS t FROM told), asked AS (SELECT tag AS text FROM told UNION SELECT t FROM clean WHERE regexp_matches(t, '[A-Za-z]')), """


@query("WITH RECURSIVE " + S.SQL["venue"] + SPOTS + HEARD + CLEAN + _scores("asked", "spot") + f""", tag AS (SELECT event_id, venue_id, exact AS score FROM told JOIN scored ON text = tag JOIN spot USING (name)),
named AS MATERIALIZED (SELECT event_id, venue_id, round(exact, 4) AS score, exact FROM clean JOIN (SELECT * FROM scored WHERE exact > 0 QUALIFY dense_rank() OVER (PARTITION BY text ORDER BY exact DESC) <= 2) ON text = t JOIN spot USING (name)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY exact DESC, venue_id) AS r, lead(score) OVER (PARTITION BY event_id ORDER BY exact DESC, venue_id) AS next FROM named),
hood AS (SELECT event_id, min(venue_id) AS venue_id FROM told JOIN spot USING (handle) WHERE length(location_text) >= 3 AND contains(lower(address), lower(trim(location_text))) AND (SELECT count(*) FROM spot s WHERE s.handle = told.handle) >= 2 GROUP BY 1 HAVING count(*) = 1),
told5 AS (SELECT event_id, count(DISTINCT venue_id) AS n, min(venue_id) AS venue_id FROM heard WHERE src = 5 AND venue_id IS NOT NULL GROUP BY 1),
rung AS (SELECT event_id, 0 AS rung, arg_min(venue_id, place) AS venue_id, 1.0::DOUBLE AS score FROM heard WHERE src = 1 AND venue_id IS NOT NULL GROUP BY 1
UNION ALL SELECT event_id, 1, venue_id, round(score, 4) FROM (SELECT * FROM tag QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, venue_id) = 1) WHERE score >= 0.85
UNION ALL SELECT event_id, 2, venue_id, 1.0 FROM hood UNION ALL SELECT event_id, 3, venue_id, score FROM ranked WHERE r = 1 AND score >= 0.55 AND (next IS NULL OR score - next >= 0.08) UNION ALL SELECT event_id, 4, venue_id, 1.0 FROM told5 WHERE n = 1),
won AS (SELECT * FROM rung QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY rung) = 1)
SELECT t.event_id, CASE WHEN w.rung IS NOT NULL THEN 'auto' WHEN NOT unknown AND coalesce(n, 0) <= 1 AND best >= 0.55 THEN 'queued' ELSE 'unresolved' END AS resolution, w.venue_id,
  CASE WHEN w.rung IS NOT NULL THEN [{', '.join(f"'{x}'" for x in R.RUNGS)}][w.rung + 1] WHEN unknown THEN 'venue_not_in_catalog' WHEN n > 1 THEN 'ambiguous_caption' END AS method, w.score
FROM (SELECT told.event_id, EXISTS (SELECT 1 FROM heard h WHERE h.event_id = told.event_id AND src = 1 AND h.venue_id IS NULL) AS unknown FROM told) t LEFT JOIN won w USING (event_id) LEFT JOIN told5 USING (event_id) LEFT JOIN (SELECT event_id, score AS best FROM ranked WHERE r = 1) USING (event_id)""")
def venue_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ladder over all events and venues. The events are written once, for every rung reads them."""
    spots = _spots(spark, sf_dir)
    events = cut(_told(spark, sf_dir).withColumn("clean", R.without_handles(F.col("location_text"))))
    return R.resolve(events, spots, _index(spots), *_scored(events, ["tag", "clean"], spots))


NEAR = "(trim(a.name) = trim(b.name) AND trim(a.name) <> '' OR least(length(trim(a.name)), length(trim(b.name))) >= 5 AND (contains(trim(a.name), trim(b.name)) OR contains(trim(b.name), trim(a.name))))"


@query(S.sql("venue") + f"SELECT a.venue_id, min(struct_pack(km := round({_km('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 9), id := b.venue_id)).id AS duplicate_of FROM venue a JOIN venue b ON a.k % 5 = 0 AND a.venue_id <> b.venue_id AND {NEAR} AND {_km('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 0.05 GROUP BY 1")
def stored_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For places found anew, the stored venue that is the same one."""
    v = S.venue(spark, sf_dir)
    return R.stored_duplicates(v.where("k % 5 = 0"), v)


@query(S.sql("venue") + ", w AS (SELECT DISTINCT CASE WHEN k % 3 = 0 THEN upper(name) WHEN k % 3 = 1 THEN left(name, 5) ELSE name || ' bar' END AS name FROM venue), a AS (SELECT name, trim(lower(name)) AS f FROM w), b AS (SELECT k AS id, trim(lower(name)) AS f FROM venue WHERE k % 4 = 0) SELECT a.name, arg_min(id, struct_pack(u := a.f <> b.f, n := -len(list_intersect(string_split(a.f, ' '), string_split(b.f, ' '))), i := id)) AS id FROM a JOIN b ON a.f <> '' AND b.f <> '' AND (contains(a.f, b.f) OR contains(b.f, a.f)) GROUP BY 1")
def inventory_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names looked up in an account's inventory: equal before alike, then most shared words."""
    v, k = S.venue(spark, sf_dir), F.col("k")
    name = F.when(k % 3 == 0, F.upper("name")).when(k % 3 == 1, F.left("name", F.lit(5))).otherwise(F.concat("name", F.lit(" bar")))
    return R.inventory_matches(v.select(name.alias("name")), v.where("k % 4 = 0").select(k.alias("id"), F.col("name").alias("title")))


@query(S.sql("venue") + """, c AS (SELECT v.k AS key, r.i AS place, trim(v.name) AS name, trim(o.name) AS candidate FROM venue v CROSS JOIN range(7) r(i) JOIN venue o ON o.k = (v.k + r.i * r.i * 3) % (SELECT count(*) FROM part))
SELECT key, min(place) AS place, arg_min(candidate, place) AS candidate FROM c WHERE place < 5 AND (name = candidate AND name <> '' OR least(length(name), length(candidate)) >= 5 AND (contains(name, candidate) OR contains(candidate, name))) AND place > 0 GROUP BY 1""")
def place_candidate_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the candidates that a search returned, the first whose name fits."""
    v = S.venue(spark, sf_dir).select("k", F.trim("name").alias("name"))
    asked = _counted(v, spark, sf_dir).withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("other", (F.col("k") + F.col("place") * F.col("place") * 3) % F.col("parts"))
    rows = asked.join(v.select(F.col("k").alias("other"), F.col("name").alias("candidate")), "other")
    return R.first_matching(rows.select(F.col("k").alias("key"), F.col("place").cast("long").alias("place"), "name", "candidate"))


@query(S.sql("venue") + SPOTS + " SELECT DISTINCT t.handle, s.venue_id, s.name FROM told t LEFT JOIN spot s ON s.handle = t.handle")
def handle_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All venues of a handle, however it is written; handles without one stay."""
    from agora_spark.functions.text import normalize_handle

    spots = _spots(spark, sf_dir).select(normalize_handle(F.upper(F.concat(F.lit("@"), "handle"))).alias("handle"), "venue_id", "name")
    return _told(spark, sf_dir).select("handle").distinct().join(spots, "handle", "left")


@query(S.sql("venue") + """, c AS (SELECT k, s.i AS source, ['website', 'archive', 'search'][s.i + 1] AS origin, [0.75, 0.4, 0.2][s.i + 1]::DOUBLE AS provenance, ['present', 'unknown', 'absent'][(k + s.i) % 3 + 1] AS found, ((k * 13 + s.i * 7) % 101) / 100.0::DOUBLE AS sim FROM venue CROSS JOIN range(3) s(i) WHERE (k + s.i) % 4 <> 0),
j AS (SELECT *, round(least(1.0, provenance + CASE WHEN found = 'present' THEN 0.15 ELSE 0 END + 0.4 * sim), 6) AS confidence, CASE WHEN found = 'unknown' THEN 0.6 ELSE 0.75 END AS bar FROM c WHERE found <> 'absent'),
b AS (SELECT *, min(source) FILTER (confidence >= bar) OVER (PARTITION BY k) AS stop FROM j)
SELECT k, arg_min(origin, struct_pack(m := -confidence, s := source)) AS origin, max(confidence) AS confidence, any_value(stop IS NOT NULL) AS accepted FROM b WHERE stop IS NULL OR source <= stop GROUP BY k""")
def handle_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in order of cost: the first that reaches its bar ends the search; the best so far is the result. Profiles known not to exist never count."""
    k, i = F.col("k"), F.col("source")
    rows = S.venue(spark, sf_dir).select("k", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("source")).where((k + i) % 4 != 0)
    pick = lambda values, at: F.get(F.array(*map(F.lit, values)), at.cast("int"))
    rows = rows.withColumns({"origin": pick(("website", "archive", "search"), i), "exists": pick(("present", "unknown", "absent"), (k + i) % 3)})
    judged = rows.withColumn("c", R.handle_confidence(pick((0.75, 0.4, 0.2), i), F.col("exists"), ((k * 13 + i * 7) % 101) / 100)).where("exists <> 'absent'")
    stop = judged.where("c.accepted").groupBy("k").agg(F.min("source").alias("stop"))
    tried = judged.join(stop, "k", "left").where("stop IS NULL OR source <= stop")
    best = tried.groupBy("k").agg(F.min(F.struct((-F.col("c.confidence")).alias("m"), "source", "origin")).alias("b"), F.max(F.col("stop").isNotNull()).alias("accepted"))
    return best.select("k", "b.origin", (-F.col("b.m")).alias("confidence"), "accepted")
