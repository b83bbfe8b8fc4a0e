"""Equal rows are compared once, and tables that grow are not broadcast."""

import datetime as dt

import pytest

from agora_spark.operators import happenings, likeness, places
from agora_spark.operators import resolution as R

VENUE = "k long, venue_id string, name string, lat double, lng double, lifecycle string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def same(spark):
    """40 venues of one name at one point, and one beside them whose name holds it."""
    return spark.createDataFrame([(k, f"v{k:02}", "bar azul", -8.0, -34.0, "active") for k in range(40)] + [(40, "v40", "Bar Azul 2", -8.0001, -34.0, "active")], VENUE)


def test_f3_duplicate_pairs(same):
    df = places.duplicate_pairs(same, 50)
    assert {(r.venue_id, r.other_venue_id) for r in df.collect()} == {(f"v{a:02}", f"v{b:02}") for b in range(41) for a in range(b)}
    assert "Broadcast" not in plan(df)


def test_f4_geo_lookups(same):
    df = R.geo_lookups(same.selectExpr("k AS request", "left(name, 3) AS name", "lat", "lng"), same)
    assert {(r.request, r.venue_id) for r in df.collect()} == {(k, "v00") for k in range(40)} | {(40, "v40")}
    assert "Broadcast" not in plan(df)


def test_f5_inventory_match(spark, same):
    df = R.inventory_matches(same.selectExpr("CASE WHEN k % 2 = 0 THEN upper(name) ELSE 'bar' END AS name"), same.selectExpr("k AS id", "name AS title"))
    assert {(r.name, r.id) for r in df.collect()} == {("BAR AZUL", 0), ("BAR AZUL 2", 40), ("bar", 0)}
    assert "Broadcast" not in plan(df)


def test_f6_stored_duplicate(same):
    df = R.stored_duplicates(same, same)
    assert {(r.venue_id, r.duplicate_of) for r in df.collect()} == {("v00", "v01")} | {(f"v{k:02}", "v00") for k in range(1, 41)}
    assert "Broadcast" not in plan(df)


def test_f9_places_are_counted_once(same, monkeypatch):
    made, real = [], places.near_pairs
    monkeypatch.setattr(places, "near_pairs", lambda *a: made.append(real(*a).count()) or real(*a))
    got = places.counts_within(same.selectExpr("k AS point", "lat", "lng"), same, 3)
    assert {(r.point, r.venues) for r in got.collect()} == {(k, 41) for k in range(41)} and made == [4]


def test_f2_a_text_is_ranked_once(spark, same, monkeypatch):
    ranked, real = [], likeness.first_n_by
    monkeypatch.setattr(likeness, "first_n_by", lambda df, *a: ranked.append(df.count()) or real(df, *a))
    heard = spark.createDataFrame([(k, "bar azul", *((-8.0, -34.0) if k % 2 else (None, None))) for k in range(60)], "event_id long, text string, lat double, lng double")
    got = {(r.event_id, r.rank, r.place) for r in likeness.ranked_links(heard, same.selectExpr("venue_id AS place", "name", "lat", "lng")).collect()}
    assert got == {(k, n + 1, f"v0{n}") for k in range(60) for n in (0, 1)} and max(ranked) <= 41


def test_f7_primary_source_is_one_that_its_sql_allows_whatever_the_order_of_rows(spark, tmp_path):
    import duckdb

    from agora_spark.plans import catalog, upkeep

    sql, con = catalog.ORACLES["primary_source"], duckdb.connect()
    allowed = sql.replace("row_number()", "rank()")  # keeps all rows of a tie
    assert allowed != sql
    new, old = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 1)
    rows = [(1, 2, new, "A"), (1, 2, new, "R"), (2, 1, old, "R"), (2, 1, old, "R"), (2, 3, old, "N"), (3, 9, old, "A"), (3, 1, new, "R"), (4, 1, None, "A"), (4, 1, None, "R")]
    for n, turn in enumerate((rows, rows[::-1])):
        sf = tmp_path / str(n)
        lines = spark.createDataFrame(turn, "l_orderkey long, l_linenumber long, l_shipdate timestamp_ntz, l_returnflag string").selectExpr("*", "1L AS l_suppkey", "1L AS l_partkey", "1.0D AS l_quantity")
        lines.coalesce(1).write.parquet(str(sf / "lineitem.parquet"))
        con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{sf}/lineitem.parquet/*.parquet'")
        got = sorted((r.event_id, r.source_id, r.seen_at, r.kind) for r in upkeep.primary_source(spark, str(sf)).collect())
        assert got == [(1, 102, new, "venue"), (2, 203, old, "venue"), (3, 301, new, "promoter"), (4, 401, None, "venue")]
        assert set(got) <= set(con.execute(allowed).fetchall())


def test_f8_newest_source_of_equal_ids_is_by_kind(spark):
    at = dt.datetime(2024, 1, 1)
    sources = spark.createDataFrame([(1, 7, at, "venue", "a"), (1, 7, at, "promoter", "z")], "event_id long, source_id long, seen_at timestamp, kind string, handle string")
    r = happenings.with_sources(spark.createDataFrame([(1,)], "event_id long"), sources).first()
    assert (r.source_kind, r.source_handle) == ("venue", "a")


def test_f10_f12_equal_events_are_judged_once_and_meet_earlier_ones(spark):
    from agora_spark.operators import runs

    at = dt.datetime(2024, 1, 1, 12)
    rows = [(k, 1, at, ["samba"]) for k in range(30)] + [(30, 1, at - dt.timedelta(hours=1), ["roda", "samba"]), (31, None, at, ["samba"]), (32, None, at, ["samba"])]
    tokens = spark.createDataFrame(rows, "event_id long, venue long, starts_at timestamp, words array<string>")
    df = runs.token_pairs(tokens)
    assert sorted((r.event_id, r.other_event_id, r.band) for r in df.collect()) == [(a, b, "auto") for a in range(31) for b in range(a + 1, 31)]
    assert "collect_list" in plan(df)  # of the events of a node
    lined = spark.createDataFrame([(k, n) for k in (0, 30) for n in ("a", "b")], "event_id long, name string")
    raised = runs.raised_pairs(tokens, lined).where("shared > 0")
    assert [(r.event_id, r.other_event_id, r.reasons, r.shared) for r in raised.collect()] == [(0, 30, "lineup,title", 2)]


def test_f11_the_ladder_reads_its_events_once_and_deals_by_event_once(spark, sf_dir):
    from agora_spark.plans import linking

    text = plan(linking.venue_ladder(spark, sf_dir))
    assert "o_orderkey" not in text
    events = spark.createDataFrame([(1, "h", "no @a", "@b")], "event_id long, handle string, location_text string, caption string")
    scores = spark.createDataFrame([], "event_id long, venue_id string, score double")
    venues = spark.createDataFrame([("v1", "h", "Rua A")], "venue_id string, handle string, address string")
    index = spark.createDataFrame([("a", "v1")], "handle string, venue_id string")
    assert plan(R.resolve(events, venues, index, scores, scores)).count("hashpartitioning(event_id") == 1


def test_f13_a_cycle_deals_by_venue_once(spark, sf_dir):
    from agora_spark.operators import projection as P
    from agora_spark.plans import projecting

    at = dt.datetime(2024, 1, 1)
    rows = lambda *r: spark.createDataFrame([(v, f, -1, p, None, at) for v, f, p in r], "venue_id string, family string, day int, payload string, ttl long, updated_at timestamp")
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "venue_id string")
    before, was = rows(("a", "x", "1"), ("a", "y", None), ("b", "x", "1"), ("c", "x", "1"), ("d", "x", "1"), ("d", "x", "0")), ids("a", "b", "c", "d")
    after, now, known = rows(("a", "x", "2"), ("a", "y", ""), ("a", "z", None), ("b", "x", "1"), ("d", "x", "1"), ("e", "x", "1"), ("f", "x", "1")), ids("a", "d", "f"), ids("a", "b", "d")
    got = P.cycle(before, was, after, now, known)
    assert sorted((r.venue_id, r.family, r.op, r.payload) for r in got.collect()) == [("a", "x", "update", "2"), ("a", "z", "insert", None), ("b", "x", "delete", None), ("f", "x", "insert", "1")]
    want = P.changes(P.read_model(before, was), P.read_model(after, now), known)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    text = plan(projecting.projection_feed(spark, sf_dir))
    assert text.count("REPARTITION_BY_COL") == 1 and "hashpartitioning(venue_id#" in text and "FullOuter" not in text


def test_f14_few_texts_are_unpacked_at_once():
    import pyarrow as pa

    from agora_spark.functions import text

    texts = pa.array(["\u0130", None, "", "\ufb01"] * 50)
    assert text._by_slices(texts, text._fold, 7).to_pylist() == ["i", None, "", "fi"] * 50 and len(text._by_slices(texts[:0], text._fold)) == 0
