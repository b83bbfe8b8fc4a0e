"""Budgets, repairs that can be resumed, pairs that are counted and not made."""

import datetime as dt
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from agora_spark.operators import runs


def test_running_sums_over_partitions(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 0, 1, 5])) for k in rng.sample(range(10_000), 700)]
    got = {r.k: (r.place, r.so_far) for r in runs.running_sum(spark.createDataFrame(rows, "k long, v long"), "v", F.col("k")).collect()}
    want, total = {}, 0
    for place, (k, v) in enumerate(sorted(rows), 1):
        total += v or 0
        want[k] = (place, total)
    assert got == want and runs.running_sum(spark.createDataFrame([], "k long, v long"), "v", F.col("k")).count() == 0


def test_a_run_ends_where_its_budget_does(spark):
    venues = spark.createDataFrame([("a", 1, 3), ("b", 1, None), ("c", 0, 1), ("d", 2, 9), ("e", 3, 0)], "venue_id string, priority int, photos int")
    done = spark.createDataFrame([("c",), ("c",)], "venue_id string")
    run = runs.archive_run(venues, done, 1.4, 0.1, 2.0)
    assert [(r.venue_id, r.place, r.units, r.spent, r.ends_after) for r in run.orderBy("place").collect()] == [("a", 1, 4, 0.4, 2.0), ("b", 2, 1, 0.5, 2.5)]  # d does not fit, so e does not come
    assert tuple(runs.estimate(run, venues, done).first()) == (5, 4, 2, 5, 0.5, 1_500_000, 2.5)
    assert tuple(runs.estimate(run.limit(0), venues.limit(0), done).first()) == (0, 0, 0, 0, 0.0, 0, 0.0)


def plain_pairs(rows, hours=8):
    day = lambda t: (t - dt.timedelta(hours=3)).date()
    return [(a, b) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[1] == b[1] and a[2] and b[2] and (day(a[2]) == day(b[2]) or abs(a[2] - b[2]) <= dt.timedelta(hours=hours))]


def test_pairs_are_counted_and_made_as_by_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(3), rng.choice([None, *(dt.datetime(2024, 3, 1) + dt.timedelta(hours=rng.randrange(0, 120)) for _ in range(6))]), sorted(rng.sample(["a", "b", "c", "d"], rng.randrange(0, 3)))) for k in range(150)]
    df = spark.createDataFrame(rows, "event_id long, venue long, starts_at timestamp, words array<string>")
    pairs = plain_pairs(rows)
    assert sum(r.pairs for r in runs.window_pairs(df).collect()) == len(pairs)
    want = {(min(a[0], b[0]), max(a[0], b[0]), "auto" if set(a[3]) <= set(b[3]) or set(b[3]) <= set(a[3]) else "suggest") for a, b in pairs if set(a[3]) & set(b[3])}
    made = runs.token_pairs(df).collect()
    assert {(r.event_id, r.other_event_id, r.band) for r in made} == want and len(made) == len(want)
    told = {k for k in range(150) if k % 3}
    out = {(r.band, r.promoter): r.pairs for r in runs.measured(df, runs.token_pairs(df), spark.createDataFrame([(k,) for k in told], "event_id long")).collect()}
    for name in ("auto", "suggest"):
        for alone in (True, False):
            assert out.get((name, alone), 0) == sum(1 for a, b, band in want if band == name and ((a in told and b in told) == alone))
    assert out["no_words", None] == sum(1 for a, b in pairs if not a[3] or not b[3]) and sum(out.values()) == len(pairs)


def test_repairs_go_on_where_they_ended(spark, tmp_path):
    path = f"file://{tmp_path}/repair"
    decided = spark.createDataFrame([(k // 10, k, "moved") for k in range(95)], "chunk long, id long, action string")
    assert [tuple(r) for r in runs.repair(path, decided, 2).orderBy("chunk").collect()] == [(0, 10, 10, 0), (1, 10, 10, 0)]
    # A run that breaks off has written rows but entered nothing.
    decided.where("chunk = 2").write.parquet(f"{path}/rows/1")
    assert runs.todo(decided, runs.ledger(spark, path)).count() == 75
    assert {(r.chunk, r.written, r.run) for r in runs.repair(path, decided, 3).collect()} == {(2, 10, 1), (3, 10, 1), (4, 10, 1)}
    assert runs.repair(path, decided).count() == 5 and runs.repair(path, decided).count() == 0
    done = runs.ledger(spark, path)
    assert done.agg(F.sum("written")).first()[0] == 95 and done.select("chunk").distinct().count() == done.count() == 10
    rows = [spark.read.parquet(f"{path}/rows/{n}") for n in range(3)]
    assert sorted(r.id for x in rows for r in x.collect()) == list(range(95))


def test_a_chunk_that_does_not_add_up_fails(spark, tmp_path, monkeypatch):
    decided = spark.createDataFrame([(0, 1), (0, 2)], "chunk long, id long")
    real = runs.todo
    monkeypatch.setattr(runs, "todo", lambda d, f: real(d, f).withColumn("chunk", F.when(F.rand() < 2, F.monotonically_increasing_id() * 0 + F.when(F.spark_partition_id() < 0, 0).otherwise(F.unix_micros(F.current_timestamp())))))
    with pytest.raises(PySparkException, match="does not add up"):  # each reading gives other chunks
        runs.repair(f"file://{tmp_path}/repair", decided)


def test_the_cascade_asks_a_tier_only_for_what_is_open(spark):
    from agora_spark.operators import resolution

    tier = "venue_id string, place int, handle string, provenance double, exists string, similarity double"
    first = spark.createDataFrame([("a", 0, "a1", 0.75, "present", 0.5), ("a", 1, "a2", 0.75, "present", 0.9), ("b", 0, "b1", 0.4, "present", 0.0), ("c", 0, "c1", 0.9, "absent", 1.0), ("d", 0, "d1", 0.4, "present", 0.2)], tier)
    second = spark.createDataFrame([("a", 0, "a9", 0.9, "present", 1.0), ("b", 0, "b2", 0.4, "unknown", 0.5), ("d", 0, "d2", 0.2, "present", 0.0)], tier)
    verdicts = spark.createDataFrame([("d", "d1", True, 0.95, "text_only"), ("b", "b1", False, 0.9, "multimodal")], "venue_id string, handle string, match boolean, confidence double, mode string")
    ids = spark.createDataFrame([(v,) for v in "abce"] + [("d",)], "venue_id string")
    found, counts = resolution.cascade(ids, [first, second], verdicts)
    got = {r.venue_id: (r.handle, r.tier, r.confidence, r.status) for r in found.collect()}
    assert got == {"a": ("a1", 0, 1.0, "found"), "b": ("b2", 1, 0.6, "found"), "c": (None, None, None, "not_found"), "d": ("d1", 0, 0.8, "found"), "e": (None, None, None, "not_found")}
    assert sorted(map(tuple, counts.collect())) == [(0, 5, 3, 2, 2), (1, 3, 1, 0, 1)]
