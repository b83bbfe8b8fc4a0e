"""Events over batches of posts: a story by hand, invariants over random batches, replays and restarts."""

import datetime as dt
import random

from pyspark.sql import functions as F

from agora_spark.operators import graph
from agora_spark.streaming import lifecycle as L

GENERIC, STOP = ["show", "live"], ["de", "do"]
AT = lambda day, hour=20: dt.datetime(2024, 3, day, hour)
PREPARED = ", ".join(c for c in L.EVENT.split(", ") if c.split()[0] not in ("status", "edited"))


def events(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in L.COLUMNS) for r in rows], L.EVENT)


def prepared(spark, rows):
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in PREPARED.split(", ")) for r in rows], PREPARED)


def row(event_id, post, title, day=1, **more):
    return {"event_id": event_id, "post": post, "venue": 1, "handle": "h", "starts_at": AT(day) if day else None, "title": title, "status": "pending", "last_seen": AT(1, 1), "kind": "event"} | more


def ran(spark, old, new, pending=()):
    s = L.step(events(spark, old), spark.createDataFrame(list(pending), L.PAIR), prepared(spark, new), GENERIC, STOP)
    return {r.event_id: r for r in s.events.collect()}, {(r.event_id, r.into, r.how) for r in s.gone.collect()}, {tuple(r) for r in s.pending.collect()}


def test_a_story(spark):
    old = [
        row(1, 10, "Samba do Zé", price="10"), row(2, 10, "Forró", 2), row(3, 11, "Jazz", 3, status="confirmed", edited=["price"], price="5"), row(4, 12, "Rock", 4, price="7", last_seen=AT(1, 2)),
        row(5, 13, "Choro", 5, venue=None, reason="unresolved_venue; low_confidence"), row(6, 14, "Longe", 9, venue=2), row(7, 15, "Moqueca", None, kind="menu", price="30"),
    ]
    new = [
        row(101, 10, "samba do ze", price="12", last_seen=AT(2)),  # updates 1; 2 is no longer told
        row(102, 11, "Jazz Trio", 3, price="9", last_seen=AT(2)),  # is 3 with another title; its price stays
        row(103, 16, "ROCK", 4, price="8", place="Sala 1", last_seen=AT(2)),  # is 4
        row(104, 17, "Choro", 5, price="1"),  # takes 5 in
        row(105, 17, "Samba", 1),  # its words are within 1's: sure
        row(106, 17, "Zé Forró Axé", 1),  # shares a word with 1: a person decides
        row(107, 18, "MOQUECA", None, kind="menu", price="35", last_seen=AT(2)),
    ]
    live, gone, pending = ran(spark, old, new)
    assert gone == {(2, None, "superseded"), (103, 4, "identity"), (107, 7, "identity"), (5, 104, "handle"), (105, 1, "title")}
    assert set(live) == {1, 3, 4, 6, 7, 104, 106} and pending == {(1, 106)}
    assert (live[1].price, live[1].title, live[1].last_seen) == ("12", "samba do ze", AT(2))
    assert (live[3].price, live[3].title, live[3].status, live[3].reason) == ("5", "Jazz Trio", "confirmed", "diverges_from_confirmed")
    assert (live[4].price, live[4].place, live[4].reason, live[4].last_seen) == ("8", "Sala 1", "sources_disagree", AT(2))
    assert (live[7].price, live[104].reason, live[6].title) == ("35", "low_confidence", "Longe")


def test_pending_suggestions_go_with_their_events_and_are_made_once(spark):
    old = [row(1, 10, "Samba Roda"), row(2, 11, "Samba Axé"), row(3, 12, "Longe", 8)]
    live, gone, pending = ran(spark, old, [row(50, 10, "Samba Roda"), row(51, 12, "Perto", 9)], [(1, 2), (2, 3), (2, 9)])
    assert gone == {(3, None, "superseded")} and pending == {(1, 2)} and set(live) == {1, 2, 51}


def some_posts(seed, n, first):
    rng = random.Random(seed)
    words = ["samba", "Forró", "choro", "jazz", "rock", "Show", "do", "Zé", "roda", "axé"]
    return [row(first + k, rng.randrange(12), " ".join(rng.choices(words, k=rng.randrange(1, 4))), rng.choice([None, 1, 2, 3]), venue=rng.choice([None, 1, 2, 3, 4]), handle=rng.choice([None, "h", "i"]), price=rng.choice([None, "", "1", "2"]), place=rng.choice([None, "a", "b"]), kind=rng.choice(["event", "event", "menu"]), last_seen=AT(rng.randrange(1, 9)), reason=rng.choice([None, "low_confidence", "unresolved_venue; x"])) for k in range(n)]


def test_random_batches_keep_the_balance(spark):
    rng, live, pending = random.Random(5), [], []
    for number in range(2):
        new = some_posts(number, 60, 1000 * (number + 1))
        s = L.step(events(spark, live), spark.createDataFrame(pending, L.PAIR), prepared(spark, new), GENERIC, STOP)
        after, gone, waiting = [r.asDict() for r in s.events.collect()], s.gone.collect(), [tuple(r) for r in s.pending.collect()]
        ids = [r["event_id"] for r in after]
        made = {r["event_id"] for r in after} | {r.event_id for r in gone}
        before = {r["event_id"] for r in live}
        assert len(ids) == len(set(ids)) and len(gone) == len({r.event_id for r in gone})  # each row has one fate
        assert before <= made and made - before <= {r["event_id"] for r in new} and not set(ids) & {r.event_id for r in gone}
        assert not {r["event_id"] for r in live if r["status"] == "confirmed"} & {r.event_id for r in gone}
        keys = [(r["venue"], r["starts_at"].date(), " ".join(r["title"].lower().replace("é", "e").replace("ó", "o").split())) for r in after if r["venue"] and r["starts_at"] and r["kind"] != "menu"]
        free = [k for k, r in zip(keys, (r for r in after if r["venue"] and r["starts_at"] and r["kind"] != "menu")) if r["status"] != "confirmed"]
        assert len(free) == len(set(free))  # no two unprotected rows of one identity are left
        assert all(a < b and {a, b} <= set(ids) for a, b in waiting) and len(waiting) == len(set(waiting))
        pending = waiting
        live = [r | ({"status": "confirmed", "edited": rng.choice([None, [], ["title"], ["venue", "price"]])} if rng.random() < 0.2 else {}) for r in after]


def test_a_batch_that_comes_again_gives_the_same(spark, tmp_path):
    path = f"file://{tmp_path}/state"
    run = L.lifecycle(path, GENERIC, STOP)
    batches = [prepared(spark, some_posts(k, 30, 1000 * (k + 1))) for k in range(3)]
    read = lambda n: {name: sorted(map(str, spark.read.parquet(f"{path}/{name}/{n}").collect())) for name in ("events", "pending", "gone")}
    for n, batch in enumerate(batches):
        run(batch, n)
    before = [read(n) for n in range(3)]
    run(batches[1], 1)
    run(batches[2], 2)
    assert [read(n) for n in range(3)] == before


def test_as_a_stream(spark, tmp_path):
    path, source = f"file://{tmp_path}/state", f"{tmp_path}/in"
    rows = prepared(spark, some_posts(1, 20, 1000))
    rows.coalesce(1).write.parquet(source)
    start = lambda: spark.readStream.schema(rows.schema).parquet(source).writeStream.foreachBatch(L.lifecycle(path, GENERIC, STOP)).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    start()
    prepared(spark, some_posts(2, 20, 2000)).coalesce(1).write.mode("append").parquet(source)
    start()  # a new query goes on from what is there
    one = L.step(spark.createDataFrame([], L.EVENT), spark.createDataFrame([], L.PAIR), rows, GENERIC, STOP)
    two = L.step(one.events, one.pending, prepared(spark, some_posts(2, 20, 2000)), GENERIC, STOP)
    assert sorted(map(str, L.read(spark, path, "events", L.EVENT).collect())) == sorted(map(str, two.events.collect()))
    assert L.read(spark, path, "events", L.EVENT).select(F.count("*")).first()[0] > 10


def test_no_table_of_a_batch_is_broadcast(spark, monkeypatch):
    plans, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    monkeypatch.setattr(L.M, "absorbed_components", lambda pairs, rows: pairs.select("event_id", F.col("other_event_id").alias("into")))
    old = [row(k, k, f"Samba {k}", 1 + k % 3, price="1") for k in range(1, 30)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 200_000)  # above any table here, below the estimate of a join of two
    try:
        s = L.step(events(spark, old), spark.createDataFrame([(1, 4)], L.PAIR), prepared(spark, [row(100 + k, k, "Samba", 1 + k % 3) for k in range(1, 30)]), GENERIC, STOP)
        plans += [df._jdf.queryExecution().executedPlan().toString() for df in (s.events, s.gone, s.pending)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) > 10 and not [p for p in plans if "Broadcast" in p]
