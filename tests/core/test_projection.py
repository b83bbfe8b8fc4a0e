"""The read model over cycles: one exchange, feeds of changes only, the same again when a cycle comes again."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from agora_spark.operators import projection as P
from agora_spark.plans import projecting

NOW = dt.datetime(2024, 1, 31)


def entry(spark, rows):
    return spark.createDataFrame([(*r, None) if len(r) == 5 else r for r in rows], "venue_id string, family string, day int, payload string, updated_at timestamp, ttl long")


def ids(spark, *venues):
    return spark.createDataFrame([(v,) for v in venues], "venue_id string")


def model(df):
    return {(r.venue_id, r.family, r.day): r.payload for r in df.collect()}


def test_one_exchange_deals_all_families(spark, sf_dir):
    made = P.snapshot(*projecting._model(spark, sf_dir))
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning(venue_id") == 1 and "Join" not in plan.replace("BroadcastNestedLoopJoin", "") and plan.count("Exchange hashpartitioning(") <= 2  # the other counts ratings by part


def test_newest_entry_of_each_key_and_photos_count_down(spark):
    at = lambda hours: NOW - dt.timedelta(hours=hours)
    tables = {P.PHOTOS: spark.createDataFrame([("a", None, "p", at(1), False), ("b", None, "old", at(50), False), ("c", None, "gone", at(1), True), ("d", None, "p", None, False)], "venue_id string, day int, payload string, updated_at timestamp, deleted boolean"), P.WEEKLY: spark.createDataFrame([("a", 3, "w3", at(2), False), ("a", 3, "older", at(9), False), ("a", 6, None, at(2), False)], "venue_id string, day int, payload string, updated_at timestamp, deleted boolean")}
    got = {r.venue_id: r for r in P.snapshot(P.entries(tables, F.lit(NOW).cast("timestamp"), 10 * 3600), ids(spark, "a", "b", "c", "d", "e")).collect()}
    assert set(got) == {"a", "b", "c", "d", "e"}
    assert (got["a"].google_places_photos, got["a"].photos_ttl, got["a"].besttime_weekly_forecast, got["a"].families) == ("p", 9 * 3600, [None, None, None, "w3", None, None, None], 2)
    assert got["b"].families == got["c"].families == got["e"].families == 0 and got["d"].photos_ttl == 36_000


def test_cycles_write_what_changed(spark, tmp_path):
    path = f"file://{tmp_path}/model"
    known = ids(spark, "a", "b", "c")
    rows = [[("a", "venue", -1, "A"), ("a", "venues.menu_data", -1, "m"), ("b", "venue", -1, "B"), ("x", "venue", -1, "X")], [("a", "venue", -1, "A"), ("b", "venue", -1, "B2"), ("c", "venue", -1, None)], [("a", "venue", -1, "A"), ("c", "venue", -1, None)]]
    rows = [[(*r, NOW) for r in cycle] for cycle in rows]
    serve = [ids(spark, "a", "b", "x"), ids(spark, "a", "b", "c"), ids(spark, "a", "c")]
    run = lambda n: P.publish(path, n, P.read_model(entry(spark, rows[n]), serve[n]), known, whole_every=2)
    ops = lambda feed: {(r.venue_id, r.family): r.op for r in feed.collect()}
    assert ops(run(0)) == {("a", "venue"): "insert", ("a", "venues.menu_data"): "insert", ("b", "venue"): "insert", ("x", "venue"): "insert"}
    assert ops(run(1)) == {("a", "venues.menu_data"): "delete", ("b", "venue"): "update", ("c", "venue"): "insert"}
    after = {("a", "venue", -1): "A", ("b", "venue", -1): "B2", ("c", "venue", -1): None, ("x", "venue", -1): "X"}  # x has no row: absence says nothing
    assert model(P.current(spark, path)) == after
    assert ops(run(1)) == {("a", "venues.menu_data"): "delete", ("b", "venue"): "update", ("c", "venue"): "insert"} and model(P.current(spark, path)) == after
    assert ops(run(2)) == {("b", "venue"): "delete"}
    assert model(P.current(spark, path)) == {k: v for k, v in after.items() if k[0] != "b"} and len(glob.glob(f"{tmp_path}/model/whole/*")) == 2
    assert P.changes(P.current(spark, path), P.current(spark, path), known).count() == 0


def test_a_cycle_without_changes_writes_none(spark, tmp_path, sf_dir):
    path = f"file://{tmp_path}/model"
    after, known = P.read_model(*projecting._model(spark, sf_dir)), ids(spark)
    assert P.publish(path, 0, after, known).count() > 1_000
    assert P.publish(path, 1, after, known).count() == 0
