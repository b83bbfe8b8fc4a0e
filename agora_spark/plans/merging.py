"""Named queries on announcements: merging, absorbing, reconciling, suggesting, protecting, erasing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora_spark.operators import happenings
from agora_spark.operators import merging as M
from agora_spark.plans.catalog import GENERIC, JUDGED, STOP, WORDS, query
from agora_spark.sources import standins as S

ANNOUNCED = S.sql("announcement") + ", known AS (SELECT *, starts_at::DATE AS day, lower(title) AS named, status = 'confirmed' AS guarded FROM announcement)"
HEADS = ", heads AS (SELECT {keys}, count(*) AS n, CASE WHEN count_if(guarded) = 1 THEN min(event_id) FILTER (guarded) WHEN count_if(guarded) = 0 THEN min(event_id) END AS canonical FROM known WHERE {where} GROUP BY {keys})"
SHOWS = HEADS.format(keys="venue, day, named", where="venue IS NOT NULL AND day IS NOT NULL AND kind = 'event'")


def _shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.identified(S.announcement(spark, sf_dir).where("kind = 'event'"), "venue", "day")


def _folded(f: str) -> str:
    said = f"o.{f} IS NOT NULL AND o.{f} <> ''"
    return f"arg_max(o.{f}, o.event_id) FILTER ({said} AND o.last_seen > c.last_seen) AS newest_{f}, arg_min(o.{f}, o.event_id) FILTER ({said}) AS first_{f}, list(DISTINCT o.{f}) FILTER ({said}) AS all_{f}"


def _field(f: str) -> str:
    return f"CASE WHEN c_ok AND (c_edited IS NULL OR list_contains(c_edited, '{f}')) THEN c_{f} WHEN c_ok OR coalesce(c_{f}, '') <> '' THEN coalesce(newest_{f}, c_{f}) ELSE coalesce(newest_{f}, first_{f}, c_{f}) END AS {f}"


def _differs(f: str) -> str:
    return f"len(list_distinct(coalesce(all_{f}, []) || CASE WHEN coalesce(c_{f}, '') <> '' THEN [c_{f}] ELSE [] END)) > 1"


def _diverges(f: str) -> str:
    return f"(c_edited IS NULL OR list_contains(c_edited, '{f}')) AND len(list_filter(coalesce(all_{f}, []), lambda x: x IS DISTINCT FROM c_{f})) > 0"


@query(ANNOUNCED + SHOWS + f""", folded AS (SELECT h.canonical, h.n, c.price AS c_price, c.place AS c_place, c.edited AS c_edited, c.guarded AS c_ok, c.reason AS c_reason, {_folded('price')}, {_folded('place')}
  FROM heads h JOIN known c ON c.event_id = h.canonical JOIN known o ON o.venue = h.venue AND o.day = h.day AND o.named = h.named AND o.kind = 'event' AND o.event_id <> h.canonical WHERE h.n > 1 GROUP BY ALL)
SELECT canonical, n, {_field('price')}, {_field('place')}, CASE WHEN c_ok THEN CASE WHEN {_diverges('price')} OR {_diverges('place')} THEN '{M.DIVERGES}' ELSE c_reason END WHEN {_differs('price')} OR {_differs('place')} THEN '{M.DISAGREE}' ELSE c_reason END AS reason, c_ok AND c_edited IS NULL AS frozen FROM folded""")
def merged_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the canonical row of each event holds once its duplicates are folded in."""
    return M.merged_fields(_shows(spark, sf_dir), ["venue", "day", "named"], ["price", "place"])


@query(ANNOUNCED + SHOWS + " SELECT k.event_id, canonical AS \"into\" FROM known k JOIN heads h ON k.venue = h.venue AND k.day = h.day AND k.named = h.named WHERE kind = 'event' AND n > 1 AND k.event_id <> canonical")
def exact_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of one identity go into which."""
    rows, keys = _shows(spark, sf_dir), ["venue", "day", "named"]
    heads = M.canonical_of(rows, keys).where("n > 1 AND canonical IS NOT NULL")
    return rows.join(heads, keys).where("event_id <> canonical").select("event_id", F.col("canonical").alias("into"))


FOLD = "nullif(array_to_string(list_filter(parts, lambda x, i: x <> '' AND x <> 'unresolved_venue' AND list_position(parts, x) = i), '; '), '')"


@query(ANNOUNCED + HEADS.format(keys="handle, day, named", where="venue IS NOT NULL AND handle IS NOT NULL AND day IS NOT NULL") + f""", sure AS (SELECT handle, day, named, min(venue) AS venue FROM known WHERE venue IS NOT NULL AND handle IS NOT NULL AND day IS NOT NULL GROUP BY ALL HAVING count(DISTINCT venue) = 1),
j AS (SELECT k.event_id, h.canonical, s.venue, c.guarded, c.reason, string_split(coalesce(c.reason, ''), '; ') || string_split(coalesce(k.reason, ''), '; ') AS parts FROM known k JOIN heads h USING (handle, day, named) JOIN sure s USING (handle, day, named) JOIN known c ON c.event_id = h.canonical
  WHERE k.venue IS NULL AND NOT k.guarded AND NOT coalesce(list_contains(k.edited, 'venue'), false))
SELECT event_id, canonical AS "into", venue, CASE WHEN guarded THEN reason ELSE {FOLD} END AS reason FROM j""")
def handle_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a venue that take the one of their account's other announcement."""
    return M.absorbed_by_handle(S.announcement(spark, sf_dir))


@query(ANNOUNCED + HEADS.format(keys="venue, named", where="venue IS NOT NULL AND kind = 'menu'") + " SELECT venue, named, n, canonical, first_seen, last_seen FROM heads JOIN (SELECT venue, named, min(last_seen) AS first_seen, max(last_seen) AS last_seen FROM known WHERE kind = 'menu' GROUP BY ALL) USING (venue, named) WHERE n > 1")
def menu_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dishes have no day: venue and title alone identify them."""
    rows = M.identified(S.announcement(spark, sf_dir).where("kind = 'menu'"), "venue")
    keys = ["venue", "named"]
    seen = rows.groupBy(*keys).agg(F.min("last_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return M.canonical_of(rows, keys).where("n > 1").join(seen, keys).select("venue", "named", "n", "canonical", "first_seen", "last_seen")


@query(ANNOUNCED + f", j AS (SELECT a.event_id, string_split(coalesce(a.reason, ''), '; ') || string_split(coalesce(b.reason, ''), '; ') AS parts FROM known a JOIN known b ON b.event_id = a.event_id + 1) SELECT event_id, {FOLD} AS reason FROM j")
def folded_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons of a row and the next one, as one list."""
    rows = S.announcement(spark, sf_dir).select("event_id", "reason")
    other = rows.select((F.col("event_id") - 1).alias("event_id"), F.col("reason").alias("other"))
    return rows.join(other, "event_id").select("event_id", M.fold_reasons(F.col("reason"), F.col("other")).alias("reason"))


@query(S.sql("source") + " SELECT event_id, string_agg(name, ',' ORDER BY place, name) AS lineup FROM (SELECT event_id, 'p' || (part % 5) AS name, min(line) AS place FROM source GROUP BY ALL) GROUP BY 1")
def lineup_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All names of an event's posts, in the order in which they first come."""
    rows = S.post_source(spark, sf_dir).select("event_id", "line", F.concat(F.lit("p"), F.col("part") % 5).alias("name"))
    return M.union_in_order(rows, "event_id", "line", "name").select("event_id", F.array_join("items", ",").alias("lineup"))


ACTS = ", act AS (SELECT event_id, line * 1000000 + part AS line, CASE WHEN line % 2 = 0 THEN 'DJ ' ELSE 'dj ' END || (part % 2) AS name, CASE part % 3 WHEN 0 THEN 'dj' WHEN 1 THEN 'other' END AS type, CASE part % 5 WHEN 0 THEN 'sun' WHEN 1 THEN 'moon' END AS stage, 's' || (part % 4) AS style FROM source)"


@query(S.sql("source") + ACTS + """, firsts AS (SELECT event_id, lower(name) AS named, arg_min(stage, line) AS first_stage FROM act WHERE stage IS NOT NULL GROUP BY ALL), placed AS (SELECT act.*, lower(name) AS named, coalesce(stage, first_stage) AS slot FROM act LEFT JOIN firsts f ON f.event_id = act.event_id AND f.named = lower(act.name)),
styled AS (SELECT event_id, named, slot, string_agg(style, ',' ORDER BY pos, style) AS styles FROM (SELECT event_id, named, slot, style, min(line) AS pos FROM placed GROUP BY ALL) GROUP BY ALL)
SELECT p.event_id, arg_min(name, line) AS name, coalesce(arg_min(type, line) FILTER (type IN ('dj', 'live')), 'other') AS type, p.slot AS stage, any_value(styles) AS styles FROM placed p JOIN styled s ON s.event_id = p.event_id AND s.named = p.named AND s.slot IS NOT DISTINCT FROM p.slot GROUP BY p.event_id, p.named, p.slot""")
def attraction_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acts of an event's posts, one row a slot."""
    part, line = F.col("part"), F.col("line")
    rows = S.post_source(spark, sf_dir).select("event_id", (line * 1_000_000 + part).alias("line"), F.concat(F.when(line % 2 == 0, "DJ ").otherwise("dj "), part % 2).alias("name"), F.when(part % 3 == 0, "dj").when(part % 3 == 1, "other").alias("type"), F.when(part % 5 == 0, "sun").when(part % 5 == 1, "moon").alias("stage"), F.array(F.concat(F.lit("s"), part % 4)).alias("styles"))
    return M.union_attractions(rows, "event_id", "line").select("event_id", "name", "type", "stage", F.array_join("styles", ",").alias("styles"))


READ_AGAIN = """, old AS (SELECT post, event_id, title, starts_at, status FROM announcement WHERE event_id % 2 = 0),
fresh AS (SELECT post, CASE WHEN event_id % 2 = 0 THEN event_id + 10000000 ELSE event_id END AS event_id, CASE WHEN event_id % 8 = 0 THEN title || ' Remix' ELSE title END AS title, CASE WHEN event_id % 12 = 0 THEN starts_at + INTERVAL 1 DAY ELSE starts_at END AS starts_at FROM announcement WHERE event_id % 2 = 0 AND event_id % 10 <> 0 AND post % 3 <> 0 OR event_id % 20 = 1 OR post % 3 = 0 AND event_id % 20 = 4)"""


def _readings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What posts have stored, and what is read from them again: some titles and days drift, some items go, some come."""
    rows, k = S.announcement(spark, sf_dir), F.col("event_id")
    old = rows.where("event_id % 2 = 0").select("post", "event_id", "title", "starts_at", "status")
    again = rows.where("event_id % 2 = 0 AND event_id % 10 <> 0 AND post % 3 <> 0 OR event_id % 20 = 1 OR post % 3 = 0 AND event_id % 20 = 4")
    title = F.when(k % 8 == 0, F.concat("title", F.lit(" Remix"))).otherwise(F.col("title"))
    starts_at = F.when(k % 12 == 0, F.col("starts_at") + F.make_dt_interval(days=F.lit(1))).otherwise(F.col("starts_at"))
    return old, again.select("post", F.when(k % 2 == 0, k + 10_000_000).otherwise(k).alias("event_id"), title.alias("title"), starts_at.alias("starts_at"))


@query(S.sql("announcement") + READ_AGAIN + """, o AS (SELECT *, lower(title) AS named, starts_at::DATE AS day, status = 'confirmed' AS guarded FROM old), f AS (SELECT post, lower(title) AS named, starts_at::DATE AS day, min(event_id) AS event_id FROM fresh GROUP BY ALL),
m AS (SELECT coalesce(o.post, f.post) AS post, o.event_id AS old_id, f.event_id AS new_id, o.named AS old_named, f.named AS new_named, o.day AS old_day, f.day AS new_day, guarded FROM o FULL JOIN f ON o.post = f.post AND o.named = f.named AND o.day IS NOT DISTINCT FROM f.day),
lone AS (SELECT post, min(old_id) FILTER (new_id IS NULL AND guarded) AS old_id, count(*) FILTER (new_id IS NULL AND guarded) AS n_old, min(new_id) FILTER (old_id IS NULL) AS new_id, count(*) FILTER (old_id IS NULL) AS n_new FROM m GROUP BY 1),
pair AS (SELECT l.post, l.old_id, l.new_id, b.new_named FROM lone l JOIN m a ON a.old_id = l.old_id AND a.new_id IS NULL JOIN m b ON b.new_id = l.new_id AND b.old_id IS NULL WHERE n_old = 1 AND n_new = 1 AND (a.old_named = b.new_named) <> coalesce(a.old_day = b.new_day, false)),
r AS (SELECT m.post, coalesce(m.old_id, m.new_id) AS event_id, CASE WHEN pair.old_id = m.old_id THEN pair.new_named ELSE coalesce(m.new_named, m.old_named) END AS named, CASE WHEN m.old_id IS NOT NULL AND m.new_id IS NOT NULL THEN 'updated' WHEN m.old_id = pair.old_id THEN 'paired' WHEN m.old_id IS NULL THEN 'inserted' WHEN guarded THEN 'absent' ELSE 'superseded' END AS outcome
  FROM m LEFT JOIN pair ON pair.post = m.post WHERE NOT coalesce(m.old_id IS NULL AND m.new_id = pair.new_id, false))
SELECT post, event_id, outcome, CASE WHEN outcome = 'superseded' THEN (SELECT CASE WHEN count(*) = 1 THEN min(x.event_id) END FROM r x WHERE x.post = r.post AND x.named = r.named AND x.outcome IN ('updated', 'paired', 'inserted')) END AS successor FROM r""")
def post_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts that were read again: what is updated, inserted, kept, or superseded and by what."""
    return M.reconcile(*_readings(spark, sf_dir))


@query(S.sql("announcement") + """, m AS (SELECT a.event_id, a.edited, a.price AS old_price, a.place AS old_place, b.price AS new_price, b.place AS new_place FROM announcement a JOIN announcement b ON b.event_id = a.event_id + 3 WHERE a.status = 'confirmed' AND a.edited IS NOT NULL),
d AS (SELECT *, coalesce(new_price, '') <> '' AND new_price IS DISTINCT FROM old_price AS dp, coalesce(new_place, '') <> '' AND new_place IS DISTINCT FROM old_place AS dl, list_contains(edited, 'price') AS ep, list_contains(edited, 'place') AS el FROM m)
SELECT event_id, CASE WHEN dp AND NOT ep THEN new_price ELSE old_price END AS price, CASE WHEN dl AND NOT el THEN new_place ELSE old_place END AS place, dp AND ep OR dl AND el AS diverges FROM d""")
def field_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that an operator set stay, whatever a later reading says."""
    rows = S.announcement(spark, sf_dir)
    old = rows.where("status = 'confirmed' AND edited IS NOT NULL").select("event_id", "edited", F.col("price").alias("old_price"), F.col("place").alias("old_place"))
    new = rows.select((F.col("event_id") - 3).alias("event_id"), F.col("price").alias("new_price"), F.col("place").alias("new_place"))
    return M.protected_fields(old.join(new, "event_id"), ["price", "place"])


@query(S.sql("item") + WORDS + JUDGED + ", p AS (SELECT least(event_id, other_event_id) AS low, greatest(event_id, other_event_id) AS high FROM judged WHERE band = 'suggest') SELECT low, high FROM p WHERE (low + high) % 3 <> 0")
def pending_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggested pairs that are not pending yet; a pair is the same in either order."""
    pairs = happenings.judged_pairs(S.post_item(spark, sf_dir), GENERIC, STOP).where("band = 'suggest'").select(F.col("event_id").alias("a"), F.col("other_event_id").alias("b"))
    return M.new_suggestions(pairs, pairs.where("(a + b) % 3 = 0").select(F.col("b").alias("a"), F.col("a").alias("b")))


LOGGED = "log AS (SELECT user_id AS suggestion, ts, event_id, CASE event_type WHEN 'click' THEN 'apply' WHEN 'view' THEN 'reject' WHEN 'purchase' THEN 'reverse' END AS action FROM events)"


@query(f"WITH {LOGGED}, d AS (SELECT suggestion, action, ts, event_id FROM log WHERE action IN ('apply', 'reject') QUALIFY row_number() OVER (PARTITION BY suggestion ORDER BY ts, event_id) = 1) SELECT DISTINCT l.suggestion, CASE WHEN d.action IS NULL THEN 'pending' WHEN d.action = 'reject' THEN 'rejected' WHEN EXISTS (SELECT 1 FROM log r WHERE r.suggestion = l.suggestion AND r.action = 'reverse' AND (r.ts > d.ts OR r.ts = d.ts AND r.event_id > d.event_id)) THEN 'reversed' ELSE 'applied' END AS state FROM log l LEFT JOIN d USING (suggestion)")
def suggestion_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    action = F.when(kind == "click", "apply").when(kind == "view", "reject").when(kind == "purchase", "reverse")
    return M.suggestion_states(S.read(spark, sf_dir, "events").select(F.col("user_id").alias("suggestion"), F.struct("ts", "event_id").alias("at"), action.alias("action")))


@query("WITH RECURSIVE " + S.SQL["item"] + WORDS + JUDGED + """, free AS (SELECT event_id AS a, other_event_id AS b FROM judged WHERE band = 'auto' AND event_id % 6 <> 2 AND other_event_id % 6 <> 2), edge AS (SELECT a, b FROM free UNION SELECT b, a FROM free),
walk(node, seen) AS (SELECT a, a FROM edge UNION SELECT e.b, w.seen FROM walk w JOIN edge e ON e.a = w.node), part AS (SELECT node AS event_id, min(seen) AS component FROM walk GROUP BY 1),
m AS (SELECT event_id, component, status = 'confirmed' AS guarded FROM part JOIN item USING (event_id)), h AS (SELECT component, CASE WHEN count_if(guarded) = 1 THEN min(event_id) FILTER (guarded) WHEN count_if(guarded) = 0 THEN min(event_id) END AS head FROM m GROUP BY 1)
SELECT event_id, head AS "into" FROM m JOIN h USING (component) WHERE event_id <> head AND NOT guarded""")
def component_absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sure pairs, without those whose title an operator set, make components; each goes into its canonical row."""
    items = S.post_item(spark, sf_dir)
    pairs = happenings.judged_pairs(items, GENERIC, STOP).where("band = 'auto'")
    edited = F.when(F.col("event_id") % 6 == 2, F.array(F.lit("title"))).otherwise(F.array(F.lit("price")))
    return M.absorbed_components(pairs, items.select("event_id", "status", edited.alias("edited")))


@query(S.sql("announcement") + " SELECT a.event_id, coalesce(nullif(a.place, ''), b.place) AS place, coalesce(a.handle, b.handle) AS handle FROM announcement a LEFT JOIN announcement b ON b.event_id = a.event_id + 1")
def provenance_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later finding fills what is missing and never replaces what is known."""
    rows = S.announcement(spark, sf_dir).select("event_id", "place", "handle")
    found = rows.select((F.col("event_id") - 1).alias("event_id"), F.col("place").alias("new_place"), F.col("handle").alias("new_handle"))
    return rows.join(found, "event_id", "left").select("event_id", F.coalesce(F.nullif("place", F.lit("")), "new_place").alias("place"), F.coalesce("handle", "new_handle").alias("handle"))


@query(S.sql("announcement") + " SELECT kind, status, CASE WHEN coalesce(reason, '') = '' AND (starts_at IS NOT NULL OR kind = 'menu') AND venue IS NOT NULL AND event_id % 10 >= 5 THEN 'accepted' ELSE 'pending_review' END AS verdict, count(*) AS n FROM announcement GROUP BY ALL")
def clean_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many readings need no review."""
    clean = M.clean_extraction(F.col("reason"), F.col("starts_at"), F.col("venue"), (F.col("event_id") % 10) / 10, F.col("kind"))
    return S.announcement(spark, sf_dir).groupBy("kind", "status", F.when(clean, "accepted").otherwise("pending_review").alias("verdict")).agg(F.count("*").alias("n"))


@query(S.sql("engagement") + """, marked AS (SELECT DISTINCT user_id, venue_id, event_type FROM engagement WHERE event_type IN ('click', 'error')) SELECT user_id, venue_id, 'blocked' AS relation FROM marked WHERE event_type = 'error'
UNION ALL SELECT user_id, venue_id, 'favourite' FROM marked f WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM marked b WHERE b.user_id = f.user_id AND b.venue_id = f.venue_id AND b.event_type = 'error')""")
def block_clears_favourite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blocked venue is no favourite: both tables after the blocks, from one pass."""
    rows = S.engagement(spark, sf_dir).groupBy("user_id", "venue_id").agg(F.bool_or(F.col("event_type") == "error").alias("blocked"), F.bool_or(F.col("event_type") == "click").alias("liked"))
    return rows.where("blocked OR liked").select("user_id", "venue_id", F.when(F.col("blocked"), "blocked").otherwise("favourite").alias("relation"))


@query(S.sql("engagement") + "SELECT user_id % 10 = 0 AS erased, event_type, CASE WHEN user_id % 10 = 0 THEN 0 ELSE count(*) END AS kept, CASE WHEN user_id % 10 = 0 THEN count(*) ELSE 0 END AS purged, count(DISTINCT venue_id) AS venues FROM engagement GROUP BY user_id % 10 = 0, event_type")
def user_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who ask for it are erased: what stays, and what goes by kind and venue."""
    rows = S.engagement(spark, sf_dir)
    asked = rows.where("user_id % 10 = 0").select("user_id").distinct()
    stays, goes = rows.join(asked, "user_id", "left_anti"), rows.join(asked, "user_id", "left_semi")
    count = lambda df, gone: df.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("venue_id").alias("venues")).select(F.lit(gone).alias("erased"), "event_type", F.when(F.lit(gone), 0).otherwise(F.col("n")).alias("kept"), F.when(F.lit(gone), F.col("n")).otherwise(0).alias("purged"), "venues")
    return count(stays, False).unionByName(count(goes, True))


@query(S.sql("venue") + "SELECT venue_id, CASE WHEN lifecycle = 'deprecated' AND NOT (reason = 'eligibility' AND k % 2 = 0) THEN 'deprecated' ELSE 'active' END AS lifecycle, CASE WHEN lifecycle = 'deprecated' AND NOT (reason = 'eligibility' AND k % 2 = 0) THEN reason END AS reason FROM venue")
def deprecation_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert leaves a deprecated venue deprecated; a restore brings back only what the eligibility sweep took out."""
    back = S.venue(spark, sf_dir).where("k % 2 = 0 AND reason = 'eligibility'").select("venue_id", F.lit(True).alias("back"))
    rows = S.venue(spark, sf_dir).join(back, "venue_id", "left")
    stays = (F.col("lifecycle") == "deprecated") & F.col("back").isNull()
    return rows.select("venue_id", F.when(stays, "deprecated").otherwise("active").alias("lifecycle"), F.when(stays, F.col("reason")).alias("reason"))


@query(S.sql("announcement") + " SELECT event_id, CASE WHEN venue IS NOT NULL AND starts_at IS NOT NULL AND kind <> 'menu' THEN venue || '|' || strftime(starts_at, '%Y-%m-%d') || '|' || lower(title) END AS event_identity, CASE WHEN venue IS NOT NULL AND kind = 'menu' THEN venue || '|' || lower(title) END AS menu_identity, CASE WHEN handle IS NOT NULL AND starts_at IS NOT NULL THEN handle || '|' || strftime(starts_at, '%Y-%m-%d') || '|' || lower(title) END AS handle_identity FROM announcement")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three identities; each is null where a part is missing."""
    day, title = F.date_format("starts_at", "yyyy-MM-dd"), F.lower("title")
    joined = lambda ok, *parts: F.when(ok, F.concat_ws("|", *(p.cast("string") for p in parts)))
    return S.announcement(spark, sf_dir).select("event_id", joined(F.col("venue").isNotNull() & day.isNotNull() & (F.col("kind") != "menu"), F.col("venue"), day, title).alias("event_identity"), joined(F.col("venue").isNotNull() & (F.col("kind") == "menu"), F.col("venue"), title).alias("menu_identity"), joined(F.col("handle").isNotNull() & day.isNotNull(), F.col("handle"), day, title).alias("handle_identity"))
