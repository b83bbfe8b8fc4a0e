"""Announcements of one event brought together: identities, folds of fields, absorption, reconciliation, suggestions.

Announcements have event_id, post, venue, handle, starts_at, title, status, last_seen, reason (parts joined by "; "),
edited (names of the fields that an operator set; null where that was not recorded) and the fields to be merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora_spark.functions.text import normalize_title
from agora_spark.operators.happenings import source_key

UNRESOLVED = "unresolved_venue"
DISAGREE, DIVERGES = "sources_disagree", "diverges_from_confirmed"


def filled(value: Column) -> Column:
    """A value that says something: neither null nor the empty text."""
    return value.isNotNull() & (value.cast("string") != "")


def is_protected(status: Column) -> Column:
    return F.coalesce(status == "confirmed", F.lit(False))


def identified(rows: DataFrame, *parts: str) -> DataFrame:
    """Rows whose identity is complete, with day and the normalised title; parts: the columns beside day and title."""
    known = rows.withColumns({"day": F.to_date("starts_at"), "named": normalize_title(F.col("title"))})
    for part in parts:
        known = known.where(F.col(part).isNotNull())
    return known


def canonical_of(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, canonical): the only protected row of a group, else the one of the smallest id; null if several are protected."""
    guarded = is_protected(F.col("status"))
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(guarded).alias("_g"), F.min("event_id").alias("_low"), F.min(F.when(guarded, F.col("event_id"))).alias("_kept"))
    return found.select(*keys, "n", F.when(F.col("_g") == 1, F.col("_kept")).when(F.col("_g") == 0, F.col("_low")).alias("canonical"))


def merged_fields(rows: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(canonical, n, fields, reason) of each group of at least two with a canonical row.

    The duplicates are folded in by ascending id. What the canonical row lacks is filled by the first
    that has it; where two differ, the one seen later wins, which makes the last of the duplicates seen
    after the canonical row the winner, so no step by step fold is needed. A confirmed row keeps all
    its fields if it is unknown which ones an operator has edited, else those that were edited.
    """
    groups = canonical_of(rows, keys).where("n > 1 AND canonical IS NOT NULL")
    own = rows.select(F.col("event_id").alias("canonical"), F.col("last_seen").alias("c_seen"), is_protected(F.col("status")).alias("c_confirmed"), F.col("edited").alias("c_edited"), F.col("reason").alias("c_reason"), *(F.col(f).alias(f"c_{f}") for f in fields))
    head = groups.join(own, "canonical")
    others = rows.select(*keys, "event_id", "last_seen", *fields).join(head.select(*keys, "canonical", "c_seen"), keys).where("event_id <> canonical")
    newer = F.col("last_seen") > F.col("c_seen")
    parts = []
    for f in fields:
        said = filled(F.col(f))
        parts += [
            F.max_by(F.when(said & newer, F.col(f)), F.when(said & newer, F.col("event_id"))).alias(f"newest_{f}"), F.min_by(F.when(said, F.col(f)), F.when(said, F.col("event_id"))).alias(f"first_{f}"),
            F.min(F.when(said, F.col(f))).alias(f"low_{f}"), F.max(F.when(said, F.col(f))).alias(f"high_{f}"),
        ]
    folded = head.join(others.groupBy("canonical").agg(*parts), "canonical")
    frozen = F.col("c_confirmed") & F.col("c_edited").isNull()
    columns, disagree, diverge = [], F.lit(False), F.lit(False)
    for f in fields:
        c, newest, first, low, high = (F.col(f"{x}_{f}") for x in ("c", "newest", "first", "low", "high"))
        held = F.col("c_confirmed") & (F.col("c_edited").isNull() | F.array_contains("c_edited", f))
        differs = F.coalesce((low != high) | (filled(c) & ((low != c) | (high != c))), F.lit(False))
        from_own = low.isNotNull() & (~filled(c) | (low != c) | (high != c))
        disagree = disagree | differs
        diverge = diverge | (held & F.coalesce(from_own, F.lit(False)))
        columns.append(F.when(held, c).when(F.col("c_confirmed") | filled(c), F.coalesce(newest, c)).otherwise(F.coalesce(newest, first, c)).alias(f))
    reason = F.when(F.col("c_confirmed"), F.when(diverge, DIVERGES).otherwise(F.col("c_reason"))).otherwise(F.when(disagree, DISAGREE).otherwise(F.col("c_reason")))
    return folded.select("canonical", "n", *columns, reason.alias("reason"), frozen.alias("frozen"))


def fold_reasons(a: Column, b: Column, drop: str = UNRESOLVED) -> Column:
    """The different parts of both reasons in order, without one; null if none is left."""
    parts = F.concat(*(F.split(F.coalesce(x, F.lit("")), "; ") for x in (a, b)))
    return F.nullif(F.array_join(F.array_distinct(F.filter(parts, lambda p: (p != "") & (p != drop))), "; "), F.lit(""))


def absorbed_by_handle(rows: DataFrame) -> DataFrame:
    """(event_id, into, venue, reason): rows without a venue that take it from a row of the same account, day and title.

    Only where the resolved rows of the group have one venue and at most one of them is protected.
    Protected rows and those whose venue an operator set are left alone.
    """
    keys = ["handle", "day", "named"]
    known = identified(rows, "handle", "day")
    resolved = known.where("venue IS NOT NULL")
    sure = resolved.groupBy(*keys).agg(F.min("venue").alias("low"), F.max("venue").alias("high")).where("low = high").select(*keys, F.col("low").alias("into_venue"))
    heads = canonical_of(resolved, keys).where("canonical IS NOT NULL").select(*keys, F.col("canonical").alias("into")).join(sure, keys)
    heads = heads.join(rows.select(F.col("event_id").alias("into"), F.col("reason").alias("into_reason"), is_protected(F.col("status")).alias("into_confirmed")), "into")
    free = known.where("venue IS NULL").where(~is_protected(F.col("status"))).where(~F.coalesce(F.array_contains("edited", "venue"), F.lit(False)))
    reason = F.when(F.col("into_confirmed"), F.col("into_reason")).otherwise(fold_reasons(F.col("into_reason"), F.col("reason")))
    return free.join(heads, keys).select("event_id", "into", F.col("into_venue").alias("venue"), reason.alias("reason"))


def union_in_order(rows: DataFrame, key: str, order: str, item: str) -> DataFrame:
    """(key, items): the different items of a key in the order in which they first come. Repeats are dropped before the shuffle."""
    firsts = rows.where(F.col(item).isNotNull()).groupBy(key, item).agg(F.min(order).alias("_at"))
    return firsts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", item))).alias("_l")).select(key, F.transform("_l", lambda x: x[item]).alias("items"))


def union_attractions(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, name, type, stage, styles) of acts (key, order, name, type, stage, styles): one row a slot.

    Acts of one folded name are one slot for each stage that is named. Those without a stage join the
    name's first slot, whichever comes first, as a teaser and a later flyer mean the same slot. A
    specific type (dj, live) beats other, the first specific one stays; styles are joined in order.
    """
    acts = rows.withColumn("named", normalize_title(F.col("name")))
    # A name's slots open in order; the first of all takes what has no stage, and the first named stage if it has none itself.
    stages = acts.where("stage IS NOT NULL").groupBy(key, "named", "stage").agg(F.min(order).alias("opened"))
    first = stages.groupBy(key, "named").agg(F.min_by("stage", F.struct("opened", "stage")).alias("first_stage"))
    placed = acts.join(first, [key, "named"], "left").withColumn("slot", F.coalesce("stage", "first_stage"))
    known = F.col("type").isin("dj", "live")
    out = placed.groupBy(key, "named", "slot").agg(F.min_by("name", order).alias("name"), F.coalesce(F.min_by(F.when(known, F.col("type")), F.when(known, F.col(order))), F.lit("other")).alias("type"), F.min(order).alias("place"), F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "styles"))).alias("s"))
    styles = F.array_distinct(F.flatten(F.transform("s", lambda x: F.coalesce(x["styles"], F.array().cast("array<string>")))))
    return out.select(key, "name", "type", F.col("slot").alias("stage"), styles.alias("styles"), "place")


def plausibly_same(a_title: Column, a_day: Column, b_title: Column, b_day: Column) -> Column:
    """Exactly one of title and day has changed; two unknown days are not the same."""
    return (normalize_title(a_title) == normalize_title(b_title)) != F.coalesce(a_day == b_day, F.lit(False))


def reconcile(existing: DataFrame, prepared: DataFrame) -> DataFrame:
    """(post, event_id, outcome, successor) of what a post has stored and what was extracted from it anew.

    existing: (post, event_id, title, starts_at, status); prepared: (post, event_id, title, starts_at),
    where event_id is the id to give to a new row; of equal ones the smallest counts. Rows of one title
    and day match (updated). If one protected row and one new reading of a post remain, and they differ
    in title or day alone, they are one (paired). Other readings are inserted; other protected rows are
    kept (absent), the rest is superseded, by the one row of the post's reading that has its title, if
    there is just one.
    """
    keyed = lambda rows: rows.withColumn("key", source_key(F.col("title"), F.col("starts_at"))).withColumn("named", normalize_title(F.col("title"))).withColumn("day", F.to_date("starts_at"))
    old = keyed(existing).select("post", "key", F.col("event_id").alias("old_id"), F.col("named").alias("old_named"), F.col("day").alias("old_day"), is_protected(F.col("status")).alias("guarded"))
    new = keyed(prepared).groupBy("post", "key").agg(F.min(F.struct("event_id", "named", "day")).alias("n")).select("post", "key", F.col("n.event_id").alias("new_id"), F.col("n.named").alias("new_named"), F.col("n.day").alias("new_day"))
    met = old.join(new, ["post", "key"], "full")
    lone_old, lone_new = F.col("new_id").isNull(), F.col("old_id").isNull()
    left = met.groupBy("post").agg(
        F.count_if(lone_old & F.col("guarded")).alias("n_old"), F.count_if(lone_new).alias("n_new"),
        F.max(F.when(lone_old & F.col("guarded"), F.struct("old_id", "old_named", "old_day"))).alias("o"), F.max(F.when(lone_new, F.struct("new_id", "new_named", "new_day"))).alias("w"),
    )
    drifted = (F.col("o.old_named") == F.col("w.new_named")) != F.coalesce(F.col("o.old_day") == F.col("w.new_day"), F.lit(False))
    pairs = left.where((F.col("n_old") == 1) & (F.col("n_new") == 1) & drifted).select("post", F.col("o.old_id").alias("pair_old"), F.col("w.new_id").alias("pair_new"), F.col("w.new_named").alias("pair_named"))
    rows = met.join(pairs, "post", "left")
    is_pair = F.coalesce(lone_old & (F.col("old_id") == F.col("pair_old")), F.lit(False))
    outcome = (
        F.when(~lone_old & ~lone_new, "updated").when(is_pair, "paired")
        .when(lone_new, F.when(F.col("new_id").eqNullSafe(F.col("pair_new")), None).otherwise("inserted"))
        .when(F.col("guarded"), "absent").otherwise("superseded")
    )
    out = rows.select("post", F.coalesce("old_id", "new_id").alias("event_id"), F.when(is_pair, F.col("pair_named")).otherwise(F.coalesce("new_named", "old_named")).alias("named"), outcome.alias("outcome")).where("outcome IS NOT NULL")
    made = out.where("outcome IN ('updated', 'paired', 'inserted')").groupBy("post", "named").agg(F.min("event_id").alias("one"), F.max("event_id").alias("other")).where("one = other").select("post", "named", F.col("one").alias("successor"))
    return out.join(made, ["post", "named"], "left").select("post", "event_id", "outcome", F.when(F.col("outcome") == "superseded", F.col("successor")).alias("successor"))


def protected_fields(matched: DataFrame, fields: list[str]) -> DataFrame:
    """(event_id, fields, diverges) of confirmed rows (old_f, new_f, edited): what a new reading may change.

    An empty new value never replaces a known one; a field that an operator set stays, and a reading that
    differs from it is flagged; other fields take the new value.
    """
    columns, diverges = [], F.lit(False)
    for f in fields:
        old, new = F.col(f"old_{f}"), F.col(f"new_{f}")
        differs = filled(new) & ~new.eqNullSafe(old)
        set_ = F.array_contains("edited", f)
        columns.append(F.when(differs & ~set_, new).otherwise(old).alias(f))
        diverges = diverges | (differs & set_)
    return matched.select("event_id", *columns, diverges.alias("diverges"))


def new_suggestions(pairs: DataFrame, pending: DataFrame) -> DataFrame:
    """(low, high) of pairs (a, b) that are not yet pending (a, b), in whichever order either names them."""
    ordered = lambda rows: rows.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct()
    return ordered(pairs).join(ordered(pending), ["low", "high"], "left_anti")


def suggestion_states(log: DataFrame) -> DataFrame:
    """(suggestion, state) after a log (suggestion, at, action) of apply, reject and reverse.

    The first apply or reject decides a pending one; a reverse counts only after it was applied.
    """
    decides = F.col("action").isin("apply", "reject")
    folded = log.groupBy("suggestion").agg(F.min(F.when(decides, F.struct("at", "action"))).alias("first"), F.max(F.when(F.col("action") == "reverse", F.col("at"))).alias("reversed"))
    state = F.when(F.col("first").isNull(), "pending").when(F.col("first.action") == "reject", "rejected").when(F.col("reversed") > F.col("first.at"), "reversed").otherwise("applied")
    return folded.select("suggestion", state.alias("state"))


def absorbed_components(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(event_id, into): the rows of a component of sure pairs (event_id, other_event_id) go into its canonical row.

    A pair is blocked if an operator set the title or the venue of either row.
    """
    from agora_spark.operators.graph import connected

    blocked = rows.where(F.coalesce(F.arrays_overlap("edited", F.array(F.lit("title"), F.lit("venue"))), F.lit(False))).select("event_id")
    free = pairs.join(blocked, "event_id", "left_anti").join(blocked.withColumnRenamed("event_id", "other_event_id"), "other_event_id", "left_anti")
    parts = connected(free.select(F.col("event_id").alias("a"), F.col("other_event_id").alias("b"))).select(F.col("node").alias("event_id"), "component")
    members = parts.join(rows.select("event_id", "status"), "event_id")
    heads = canonical_of(members, ["component"]).where("canonical IS NOT NULL").select("component", F.col("canonical").alias("into"))
    return members.join(heads, "component").where("event_id <> into AND status <> 'confirmed'").select("event_id", "into")


def clean_extraction(reason: Column, starts_at: Column, venue: Column, confidence: Column, kind: Column, least: float = 0.5) -> Column:
    """Whether an extraction needs no review: no reason, a venue, enough confidence, and a day unless its kind needs none."""
    dateless = F.coalesce(kind.isin("promotion", "menu", "food", "other"), F.lit(False))
    return F.coalesce(~filled(reason) & (starts_at.isNotNull() | dateless) & venue.isNotNull() & (confidence >= least), F.lit(False))

