"""Which venue an event, a mention or an inventory row means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora_spark.functions.text import fold_text, mentions, names_match, normalize_handle, normalize_title
from agora_spark.operators.graph import cut
from agora_spark.operators.places import first_n_by, near_pairs

#: Fixed value: what a mention in a text looks like; no word character or dot stands before it.
MENTION = r"(?U)(?<![\w.])@([A-Za-z0-9_.]{1,30})"
#: The rungs of the ladder, best first, and how each links.
RUNGS = ("handle_mention", "location_tag", "neighbourhood_match", "name_match", "caption_handle_mention")
_UNKNOWN, _ITSELF = 5, 6  # beside the rungs: a mention that is not known, the event itself


def without_handles(text: Column) -> Column:
    """A text without its mentions, blanks squeezed; null if no letter is left."""
    bare = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, MENTION, "")).otherwise(text)
    rest = F.trim(F.regexp_replace(bare, r"\s+", " "))
    return F.when(rest.rlike(r"\p{L}"), rest)


def heard(events: DataFrame, text: str, index: DataFrame, own: str = "handle") -> DataFrame:
    """(event_id, place, handle, venue_id) of the mentions in a text in their order, without the account's own; venue_id is null if index (handle, venue_id) has none."""
    said = events.select("event_id", normalize_handle(F.col(own)).alias("own"), F.posexplode(mentions(F.col(text))).alias("place", "handle"))
    return said.where("own IS NULL OR handle <> own").join(index, "handle", "left").select("event_id", "place", "handle", "venue_id")


def neighbours(events: DataFrame, venues: DataFrame, account: str = "handle", least: int = 3) -> DataFrame:
    """(event_id, venue_id): venues of the event's own account whose address holds its location text.

    Only for accounts with at least two venues, and texts of at least `least` characters.
    """
    several = venues.groupBy(account).agg(F.count("*").alias("n")).where("n >= 2").select(account)
    text, address = normalize_title(F.col("location_text")), normalize_title(F.col("address"))
    branches = venues.join(several, account, "left_semi").select(account, "venue_id", address.alias("_address")).where("_address <> ''")
    said = events.select("event_id", account, text.alias("_text")).where(F.char_length("_text") >= least)
    return said.join(branches, account).where(F.contains("_address", F.col("_text"))).select("event_id", "venue_id")


def resolve(events: DataFrame, venues: DataFrame, index: DataFrame, tag_scores: DataFrame, name_scores: DataFrame, floor: float = 0.55, margin: float = 0.08, tag_floor: float = 0.85) -> DataFrame:
    """(event_id, resolution, venue_id, method, score) of each event: the first rung that is conclusive.

    events: (event_id, handle, location_text, caption); venues: (venue_id, handle, address); index:
    (handle, venue_id); tag_scores, name_scores: (event_id, venue_id, score) of the location tag's and of
    the location text's likeness to names. 1: the first known mention in the event's own text. 2: the
    venue most like the tag, if alike enough. 3: the only branch of the account with the text in its
    address. 4: the venue whose name is most like the text, if good enough and ahead of the next.
    5: the only known venue that the caption mentions. Else unresolved: because the event's own text names
    a handle that is not known, or the caption several venues, or nothing does; or queued, if the best
    name is good enough but not ahead.

    All that speaks for an event is dealt by event once, and placed within its rung; an event without
    anything is a row of its own.
    """
    told = events.select("event_id", "handle", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("location_text").alias("text")), F.struct(F.lit(4).alias("kind"), F.col("caption").alias("text")))).alias("t")).select(F.struct("event_id", "t.kind").alias("event_id"), "handle", "t.text")
    said = heard(told, "text", index).select("event_id.event_id", F.when((F.col("event_id.kind") == 0) & F.col("venue_id").isNull(), _UNKNOWN).otherwise(F.col("event_id.kind")).alias("kind"), F.col("place").cast("double").alias("at"), "venue_id").where(f"venue_id IS NOT NULL OR kind = {_UNKNOWN}")
    alike = lambda rows, kind: rows.select("event_id", F.lit(kind).alias("kind"), (-F.col("score")).alias("at"), "venue_id")
    alone = lambda rows, kind: rows.select("event_id", F.lit(kind).alias("kind"), F.lit(0.0).alias("at"), "venue_id")
    clues = said.unionByName(alike(tag_scores.where(F.col("score") >= tag_floor), 1)).unionByName(alone(neighbours(events, venues), 2)).unionByName(alike(name_scores.where("score > 0"), 3))
    clues = clues.unionByName(alone(events.select("event_id", F.lit(None).cast("string").alias("venue_id")), _ITSELF)).repartition("event_id")
    placed = clues.withColumn("r", F.row_number().over(Window.partitionBy("event_id", "kind").orderBy("at", "venue_id")))
    of = lambda kind, r=1: (F.col("kind") == kind) & (F.col("r") == r)
    score = lambda kind, r=1: F.max(F.when(of(kind, r), -F.col("at")))
    one = placed.groupBy("event_id").agg(
        *(F.max(F.when(of(k), F.col("venue_id"))).alias(f"v{k}") for k in range(5)), score(1).alias("tag"), F.count_if(F.col("kind") == 2).alias("branches"), score(3).alias("raw"), score(3, 2).alias("raw_next"),
        F.min(F.when(F.col("kind") == 4, F.col("venue_id"))).alias("low"), F.max(F.when(F.col("kind") == 4, F.col("venue_id"))).alias("high"), F.max(F.col("kind") == _UNKNOWN).alias("unknown"),
    )
    best, after = F.round("raw", 4), F.round("raw_next", 4)
    holds = (F.col("v0").isNotNull(), F.col("v1").isNotNull(), F.col("branches") == 1, (best >= floor) & (after.isNull() | (best - after >= margin)), F.col("low") == F.col("high"))
    scores = (F.lit(1.0), F.round("tag", 4), F.lit(1.0), best, F.lit(1.0))
    won = F.coalesce(*(F.when(fits, F.struct(F.lit(k).alias("rung"), F.col("low" if k == 4 else f"v{k}").alias("venue_id"), scores[k].alias("score"))) for k, fits in enumerate(holds)))
    out = one.select("event_id", won.alias("c"), "unknown", (F.col("low") < F.col("high")).alias("several"), best.alias("best"))
    method = F.when(F.col("c").isNotNull(), F.get(F.lit(list(RUNGS)), F.col("c.rung"))).when(F.col("unknown"), "venue_not_in_catalog").when(F.col("several"), "ambiguous_caption")
    queued = method.isNull() & (F.col("best") >= floor)
    return out.select("event_id", F.when(F.col("c").isNotNull(), "auto").when(queued, "queued").otherwise("unresolved").alias("resolution"), F.col("c.venue_id").alias("venue_id"), method.alias("method"), F.col("c.score").alias("score"))


def stored_duplicates(found: DataFrame, stored: DataFrame, metres: float = 50) -> DataFrame:
    """(venue_id, duplicate_of): of the stored venues within reach whose folded name matches and whose id is another, the nearest (ties: the smaller id).

    Of the venues of one name at one point the two smallest ids count, and of what is found for such a
    spot the two best: one of two is not the venue itself.
    """
    spot = ["lat", "lng", "folded"]
    a, b = (x.select("venue_id", "lat", "lng", fold_text(F.col("name")).alias("folded")).where("folded <> ''") for x in (found, stored))
    few = first_n_by(b.distinct(), spot, 2, F.col("venue_id"))
    pairs = near_pairs(a.select(*spot).distinct(), few, metres / 1000).where(names_match(F.col("folded"), F.col("other_folded")))
    near = pairs.groupBy(*spot, "other_venue_id").agg(F.min(F.round("km_away", 9)).alias("km"))
    best = first_n_by(near, spot, 2, F.col("km"), F.col("other_venue_id"))
    met = a.join(best.hint("merge"), spot).where(F.col("venue_id") != F.col("other_venue_id"))
    return met.groupBy("venue_id").agg(F.min(F.struct("km", "other_venue_id")).alias("m")).select("venue_id", F.col("m.other_venue_id").alias("duplicate_of"))


def geo_lookups(asked: DataFrame, venues: DataFrame, metres: float = 150) -> DataFrame:
    """(request, venue_id): the nearest active venue within reach of a request (request, name, lat, lng) whose folded name equals the asked one, holds it, or stands in it, however short (ties: the smaller id). Requests for one name at one point are one, and so are venues, by their smallest id."""
    spot = ["lat", "lng", "folded"]
    a = asked.select("request", "lat", "lng", fold_text(F.col("name")).alias("folded"))
    b = venues.where("lifecycle = 'active'").select("venue_id", "lat", "lng", fold_text(F.col("name")).alias("folded")).where("folded <> ''")
    b = b.groupBy(*spot).agg(F.min("venue_id").alias("venue_id"))
    near = near_pairs(a.select(*spot).distinct(), b, metres / 1000).where(F.contains("other_folded", F.col("folded")) | F.contains("folded", F.col("other_folded")))
    best = near.groupBy(*spot).agg(F.min(F.struct(F.round("km_away", 9).alias("km"), "other_venue_id")).alias("m"))
    return a.join(best.hint("merge"), spot).groupBy("request").agg(F.min("m").alias("m")).select("request", F.col("m.other_venue_id").alias("venue_id"))


def inventory_matches(wanted: DataFrame, inventory: DataFrame) -> DataFrame:
    """(name, id): of the inventory rows (id, title) whose folded title equals or holds a wanted name, or is held by it, the one that is equal, then shares most words, then comes first.

    What is within another begins with three characters that the other holds, so rows meet on those.
    Each folded name is compared once, and so is each folded title, by its first row.
    """
    keyed = lambda rows, c: rows.withColumn("_f", fold_text(F.col(c))).where("_f <> ''").withColumn("_w", F.array_distinct(F.split("_f", " ")))
    names = keyed(wanted.select("name").distinct(), "name").select("name", F.col("_f").alias("fa"), F.col("_w").alias("wa"))
    a = names.select("fa", "wa").distinct()
    b = keyed(inventory, "title").groupBy(F.col("_f").alias("fb"), F.col("_w").alias("wb")).agg(F.min("id").alias("id"))
    held = lambda f: F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.char_length(f)), lambda i: F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.substring(F.col(f), i, n))))))
    inside = a.withColumn("t", F.left("fa", F.lit(3))).join(b.withColumn("t", held("fb")).hint("merge"), "t").where(F.contains("fb", F.col("fa")))
    around = a.withColumn("t", held("fa")).join(b.withColumn("t", F.left("fb", F.lit(3))).hint("merge"), "t").where(F.contains("fa", F.col("fb")))
    hit = inside.unionByName(around)
    rank = F.struct((F.col("fa") != F.col("fb")).alias("unequal"), (-F.size(F.array_intersect("wa", "wb"))).alias("fewer"), "id")
    best = hit.groupBy("fa").agg(F.min(rank).alias("m"))
    return names.join(best.hint("merge"), "fa").select("name", F.col("m.id").alias("id"))


def first_matching(candidates: DataFrame, most: int = 5) -> DataFrame:
    """(key, place, candidate): the first of a key's first `most` candidates (key, place, name, candidate) whose name matches."""
    ok = candidates.where(F.col("place") < most).where(names_match(fold_text(F.col("name")), fold_text(F.col("candidate"))))
    return ok.groupBy("key").agg(F.min(F.struct("place", "candidate")).alias("m")).select("key", "m.place", "m.candidate")


def handle_confidence(provenance: Column, exists: Column, similarity: Column, accept: float = 0.75, bonus: float = 0.15, weight: float = 0.4) -> Column:
    """struct<confidence, threshold, accepted>: provenance, a bonus for a profile that exists (present, absent or unknown), and likeness of names.

    Where existence cannot be told, the threshold is lower by the bonus.
    """
    score = F.least(F.lit(1.0), provenance + F.when(exists == "present", bonus).otherwise(0.0) + weight * similarity)
    bar = F.when(exists.isin("present", "absent"), accept).otherwise(max(0.0, accept - bonus))
    return F.struct(F.round(score, 6).alias("confidence"), bar.alias("threshold"), (F.round(score, 6) >= bar).alias("accepted"))


def cascade(ids: DataFrame, tiers: list[DataFrame], verdicts: DataFrame, accept: float = 0.75, judge_floor: float = 0.45, low: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """((venue_id, handle, tier, confidence, status), (tier, asked, candidates, judged, settled)): handles of venues, tier after tier in order of cost.

    Each tier (venue_id, place, handle, provenance, exists, similarity) is read only for venues that the
    tiers before have left open, and goes through its candidates in order until one reaches its bar;
    profiles known not to exist do not count. A candidate between judge_floor and its bar takes the
    verdict on it (venue_id, handle, match, confidence, mode), if there is one: text-only verdicts count
    0.8 at most, and one against it leaves 0.4 at most. The best so far (ties: the earlier) settles a
    venue if it reaches its bar; at the end it is found, of low_confidence, or not_found.
    """
    open_, best, told, counts = ids.select("venue_id").distinct(), None, None, None
    judged_of = verdicts.select("venue_id", "handle", "match", F.col("confidence").alias("_said"), "mode")
    for number, tier in enumerate(tiers):
        rows = tier.join(open_, "venue_id", "left_semi").where("exists <> 'absent'").withColumn("_c", handle_confidence(F.col("provenance"), F.col("exists"), F.col("similarity"), accept))
        met = rows.join(judged_of, ["venue_id", "handle"], "left")
        doubtful = (F.col("_c.confidence") >= judge_floor) & ~F.col("_c.accepted") & F.col("match").isNotNull()
        ruled = F.when(F.col("match"), F.col("_said")).otherwise(F.least(F.col("_c.confidence"), F.lit(0.4)))
        ruled = F.when(F.col("mode") == "text_only", F.least(ruled, F.lit(0.8))).otherwise(ruled)
        scored = met.select("venue_id", "place", "handle", F.when(doubtful, F.round(ruled, 6)).otherwise(F.col("_c.confidence")).alias("confidence"), F.col("_c.threshold").alias("bar"), doubtful.alias("judged"))
        stops = scored.groupBy("venue_id").agg(F.min(F.when(F.col("confidence") >= F.col("bar"), F.col("place"))).alias("_stop"))
        seen = cut(scored.join(stops, "venue_id").where("_stop IS NULL OR place <= _stop"))
        mine = seen.groupBy("venue_id").agg(F.min(F.struct((-F.col("confidence")).alias("minus"), F.lit(number).alias("tier"), "place", "handle", "bar")).alias("m"))
        both = mine if best is None else best.unionByName(mine).groupBy("venue_id").agg(F.min("m").alias("m"))
        both = cut(both)
        settled = cut(both.where(-F.col("m.minus") >= F.col("m.bar")))
        one = open_.agg(F.count("*").alias("asked")).crossJoin(seen.agg(F.count("*").alias("candidates"), F.count_if("judged").alias("judged"))).crossJoin(settled.agg(F.count("*").alias("settled")))  # one row each
        counts = one.withColumn("tier", F.lit(number)) if counts is None else counts.unionByName(one.withColumn("tier", F.lit(number)))
        told = settled if told is None else told.unionByName(settled)
        open_, best = cut(open_.join(settled.select("venue_id"), "venue_id", "left_anti")), both.join(settled.select("venue_id"), "venue_id", "left_anti")
    left = told if best is None else told.unionByName(best)
    known = left.select("venue_id", F.col("m.handle").alias("handle"), F.col("m.tier").alias("tier"), (-F.col("m.minus")).alias("confidence"), F.col("m.bar").alias("_bar"))
    every = ids.select("venue_id").distinct().join(known, "venue_id", "left")
    status = F.when(F.col("confidence") >= F.col("_bar"), "found").when(F.col("confidence") >= low, "low_confidence").otherwise("not_found")
    return every.select("venue_id", "handle", "tier", "confidence", status.alias("status")), counts.select("tier", "asked", "candidates", "judged", "settled")
