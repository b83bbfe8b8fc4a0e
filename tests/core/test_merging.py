"""Merging, resolving, crawling and dating against step by step versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from agora_spark import streaming
from agora_spark.functions import recurrence, rules
from agora_spark.operators import eligibility, merging, places, posts, resolution

AT = dt.datetime(2024, 1, 1)


def fold(rows, fields):
    """The rows of one identity folded one after another, by ascending id."""
    guarded = [r for r in rows if r["status"] == "confirmed"]
    if len(guarded) > 1 or len(rows) < 2:
        return None
    head = dict(guarded[0] if guarded else min(rows, key=lambda r: r["event_id"]))
    diverges = False
    for d in sorted(rows, key=lambda r: r["event_id"]):
        if d["event_id"] == head["event_id"]:
            continue
        for f in fields:
            if not d[f] or d[f] == head[f]:
                continue
            newer = d["last_seen"] > head["last_seen"]
            if head["status"] == "confirmed":
                if head["edited"] is None or f in head["edited"]:
                    diverges = True
                elif newer:
                    head[f] = d[f]
            elif not head[f]:
                head[f] = d[f]
            else:
                diverges = True
                if newer:
                    head[f] = d[f]
    reason = head["reason"]
    if diverges:
        reason = merging.DIVERGES if head["status"] == "confirmed" else merging.DISAGREE
    return head["event_id"], len(rows), *(head[f] for f in fields), reason


def test_merged_fields_equal_a_fold_step_by_step(spark):
    rng = random.Random(5)
    rows = [
        dict(event_id=k, venue=k % 60, status=rng.choice(["pending"] * 4 + ["confirmed"]), last_seen=AT + dt.timedelta(days=rng.randrange(9)), reason=rng.choice([None, "r"]), edited=rng.choice([None, [], ["price"], ["place", "price"]]), price=rng.choice([None, "", "1", "2"]), place=rng.choice([None, "a", "b"]))
        for k in range(240)
    ]
    schema = "event_id long, venue long, status string, last_seen timestamp, reason string, edited array<string>, price string, place string"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    got = sorted(tuple(r)[:-1] for r in merging.merged_fields(df, ["venue"], ["price", "place"]).collect())
    groups = [fold([r for r in rows if r["venue"] == v], ["price", "place"]) for v in range(60)]
    assert got == sorted(g for g in groups if g)
    assert merging.merged_fields(df.limit(0), ["venue"], ["price"]).collect() == []


def test_reconcile_one_post(spark):
    old = [(1, 1, "Samba", AT, "pending"), (1, 2, "Forró", AT, "confirmed"), (1, 3, "Jazz", AT, "pending"), (2, 4, "Rock", None, "confirmed"), (3, 5, "Baile", AT, "pending"), (3, 6, "baile ", AT + dt.timedelta(days=1), "pending")]
    new = [(1, 11, "SAMBA", AT), (1, 12, "Forró pé de serra", AT), (2, 13, "Rock", None), (3, 14, "Baile", AT + dt.timedelta(days=5)), (4, 15, "Novo", AT), (4, 16, "novo", AT)]
    a = spark.createDataFrame(old, "post long, event_id long, title string, starts_at timestamp, status string")
    b = spark.createDataFrame(new, "post long, event_id long, title string, starts_at timestamp")
    got = {r.event_id: (r.outcome, r.successor) for r in merging.reconcile(a, b).collect()}
    assert got == {1: ("updated", None), 2: ("paired", None), 3: ("superseded", None), 4: ("updated", None), 5: ("superseded", 14), 6: ("superseded", 14), 14: ("inserted", None), 15: ("inserted", None)}


def test_suggestions_and_reasons(spark):
    log = [(1, 1, "apply"), (1, 2, "reverse"), (2, 1, "reject"), (2, 2, "apply"), (3, 1, "reverse"), (3, 2, "apply"), (4, 1, "reverse")]
    got = {r.suggestion: r.state for r in merging.suggestion_states(spark.createDataFrame(log, "suggestion long, at long, action string")).collect()}
    assert got == {1: "reversed", 2: "rejected", 3: "applied", 4: "pending"}
    rows = spark.createDataFrame([("a; unresolved_venue", "b; a"), (None, "unresolved_venue"), ("", None)], "a string, b string")
    assert [r[0] for r in rows.select(merging.fold_reasons(F.col("a"), F.col("b"))).collect()] == ["a; b", None, None]


def test_discovery_takes_rows_in_order(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["", None, *(f"i{x}" for x in range(20))]), rng.choice(["", None, *(f"n{x}" for x in range(20))])) for k in range(120)]
    ids, names, want = set(), set(), []
    for k, i, n in rows:
        if (i or n) and (not i or i not in ids) and (not n or n not in names):
            want.append(k)
            ids |= {i} - {"", None}
            names |= {n} - {"", None}
    df = spark.createDataFrame(rows, "place long, venue_id string, name string")
    assert sorted(r.place for r in posts.discovered(df).collect()) == want
    assert posts.discovered(df.limit(0)).collect() == []


def test_duplicate_groups_are_greedy(spark):
    rng = random.Random(4)
    rows = [(k, f"v{k}", rng.choice(["Bar Azul", "Bar Azul Pina", "Azul Pina", "Outro Lugar"]), -8.0 + rng.randrange(12) * 0.0002, -34.0) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, venue_id string, name string, lat double, lng double")
    pairs = {(r.k, r.other_k) for r in places.duplicate_pairs(df, 50).collect()}
    heads, want = [], {}
    for k in sorted({x for p in pairs for x in p}):
        head = next((h for h in heads if (h, k) in pairs), None)
        if head is None:
            heads.append(k)
        want[k] = k if head is None else head
    want = {k: h for k, h in want.items() if list(want.values()).count(h) > 1}
    assert {r.k: r.head for r in places.duplicate_groups(df, 50).collect()} == want


def test_the_ladder_prefers_its_first_rungs(spark):
    venues = spark.createDataFrame([("v1", "h1", "Rua A, Casa Forte"), ("v2", "h1", "Rua B, Pina"), ("v3", "h3", None)], "venue_id string, handle string, address string")
    index = spark.createDataFrame([("bar_um", "v1"), ("bar_dois", "v2")], "handle string, venue_id string")
    events = [(1, "h9", "no @bar_dois.", "x"), (2, "h1", "casa  forte", None), (3, "h9", "@nowhere", "@bar_um e @bar_dois"), (4, "h9", None, "@bar_um"), (5, "h9", None, "@bar_um @bar_dois"), (6, "h9", "Bar Um", None), (7, "h9", "Bar", None), (8, "bar_um", "@bar_um", None), (9, "h9", "tag", None)]
    df = spark.createDataFrame(events, "event_id long, handle string, location_text string, caption string")
    tags = spark.createDataFrame([(9, "v3", 0.9), (9, "v2", 0.2), (1, "v3", 1.0)], "event_id long, venue_id string, score double")
    names = spark.createDataFrame([(6, "v1", 0.9), (6, "v2", 0.5), (7, "v1", 0.6), (7, "v2", 0.58), (2, "v3", 0.99)], "event_id long, venue_id string, score double")
    got = {r.event_id: (r.resolution, r.venue_id, r.method) for r in resolution.resolve(df, venues, index, tags, names).collect()}
    assert got == {
        1: ("auto", "v2", "handle_mention"), 2: ("auto", "v1", "neighbourhood_match"), 3: ("unresolved", None, "venue_not_in_catalog"), 4: ("auto", "v1", "caption_handle_mention"), 5: ("unresolved", None, "ambiguous_caption"),
        6: ("auto", "v1", "name_match"), 7: ("queued", None, None), 8: ("unresolved", None, None), 9: ("auto", "v3", "location_tag"),
    }


def test_closures_and_negations_within_reach(spark):
    far, phrase = "x" * 41, "fechou as portas"
    texts = [f"o bar {phrase} ontem", f"nunca {phrase}", f"nunca {far}{phrase}", f"{phrase}{far} nunca", f"nunca {phrase}, mas {far} {phrase}", None]
    rows = spark.createDataFrame([(f"v{k}", k, AT, t) for k, t in enumerate(texts)], "venue_id string, review_id long, published timestamp, text string")
    got = {r.venue_id: r.closed for r in eligibility.closure_signals(rows, [phrase], ["nunca"]).collect()}
    assert got == {"v0": True, "v1": False, "v2": True, "v3": True, "v4": True, "v5": False}


def test_a_stream_of_upserts_starts_again(spark, tmp_path):
    path = str(tmp_path / "latest")
    batch = lambda *rows: spark.createDataFrame(rows, "k int, v string, n int")
    merge = streaming.upsert_latest(path, ["k"], "n")
    assert streaming.latest_snapshot(spark, path) is None
    merge(batch((1, "a", 1), (2, "b", 1)), 0)
    again = streaming.upsert_latest(path, ["k"], "n")  # another process
    again(batch((1, "c", 2)), 1)
    again(batch((1, "c", 2)), 1)  # the same batch once more
    again(batch((3, "d", 1)), 10)
    assert sorted(tuple(r) for r in streaming.latest_snapshot(spark, path).collect()) == [(1, "c", 2), (2, "b", 1), (3, "d", 1)]


def test_dates_of_odd_readings(spark):
    reading = lambda kind, day=None, month=None, year=None, weekday=None, relative=None: (kind, relative, day, month, year, weekday)
    cases = [
        (reading("range", 30, 4), dt.date(2024, 4, 30), False), (reading("day_month", 31, 2), None, False), (reading("day_month", 1, 1), dt.date(2025, 1, 1), True), (reading("day_month", 10, 3), dt.date(2024, 3, 10), True), (reading("day_month_year", 29, 2, 2023), None, False),
        (reading("weekday", weekday="terça-feira"), dt.date(2024, 4, 30), False), (reading("weekday_day", 31, weekday="sexta"), dt.date(2024, 5, 31), False), (reading("relative", relative="amanha"), dt.date(2024, 4, 25), False), (reading("other", 1, 1), None, False), (None, None, False),
    ]
    df = spark.createDataFrame([(k, c[0], dt.date(2024, 4, 24)) for k, c in enumerate(cases)], "k int, r struct<kind string, relative string, day int, month int, year int, weekday string>, anchor date")
    got = {x.k: (x.z.day, x.z.inferred) for x in df.select("k", recurrence.read_interpretation(F.col("r"), F.col("anchor")).alias("z")).collect()}
    assert got == {k: c[1:] for k, c in enumerate(cases)}


def test_corpus_and_budget(spark):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    day = lambda n: dt.datetime(2024, 1, 31) - dt.timedelta(days=n)
    schema = "venue_id string, review_id long, author string, published timestamp, text string"
    old = spark.createDataFrame([("a", 1, "x", day(1), "t"), ("a", 2, "x", day(400), "old"), ("a", 3, "y", None, "u")], schema)
    new = spark.createDataFrame([("a", 4, "x", day(1), "t"), ("a", 5, "z", day(2), " "), ("a", 6, "z", day(3), "w")], schema)
    assert [tuple(r) for r in posts.review_corpus(old, new, now, 365, 2).collect()] == [("a", 2, day(3), day(1), True)]
    points = spark.createDataFrame([(1, 1, 0, 50), (2, 2, 60, 50), (3, 3, 0, 30), (4, 4, 0, 30)], "point int, place int, current int, most int")
    assert [r.take for r in posts.split_budget(points, 70, 40).orderBy("point").collect()] == [40, 0, 30, 0]
    assert [r.take for r in posts.split_budget(points, -1).orderBy("point").collect()] == [50, 0, 30, 30]


@pytest.mark.parametrize("raw, want", [(" ROCK ", "Rock"), ("jazz  latino", "jazz latino"), ("  ", None), (None, None)])
def test_spelling(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "r string")
    assert df.select(rules.canonical_spelling(F.col("r"), ["Rock"])).first()[0] == want
