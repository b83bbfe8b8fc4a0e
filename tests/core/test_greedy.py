"""Greedy choices in few rounds: chains, equal places, and brute force."""

import math
import random

from agora_spark.operators import graph, places, posts

SCHEMA = "k long, venue_id string, name string, lat double, lng double"
STEP = 45 / 111_195  # degrees of 45 metres


def counted(monkeypatch):
    """How often a table is written, from now on."""
    made = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: made.append(1) or real(df))
    return made


def plain_groups(rows):
    heads, out = [], {}
    for k, _, name, lat, lng in sorted(rows):
        if lat is None or not name.strip():
            continue
        for h, other, y, x in heads:
            close = 2 * 6_371_000 * math.asin(math.sqrt(math.sin(math.radians(lat - y) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(lng - x) / 2) ** 2)) <= 50
            if close and (name == other or min(len(name), len(other)) >= 5 and (name in other or other in name)):
                out[k] = h
                break
        else:
            heads.append((k, name, lat, lng))
            out[k] = k
    return {k: h for k, h in out.items() if sum(x == h for x in out.values()) > 1}


def groups(spark, rows):
    return {r.k: r.head for r in places.duplicate_groups(spark.createDataFrame(rows, SCHEMA), 50).collect()}


def test_random_places_equal_brute_force(spark):
    rng = random.Random(1)
    names = ["bar azul", "bar azul do recife", "obar azul", "bar", "lua", "luar", "", "azul"]
    rows = [(k, f"v{k}", rng.choice(names), rng.choice([None, -8.0, -8.0, -8.0 + rng.randrange(6) * STEP]), -34.0 + rng.randrange(3) * STEP) for k in rng.sample(range(1000), 250)]
    assert groups(spark, rows) == plain_groups(rows)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    rows = [(k, f"v{k}", "bar azul", -8.0 + k * STEP, -34.0) for k in range(n)]
    made = counted(monkeypatch)
    got = groups(spark, rows)
    assert got == {k: k - k % 2 for k in range(n)}  # every other one heads
    assert len(made) <= 25  # about log2(n) of them follow pointers


def test_many_places_at_one_spot_are_one_node(spark):
    rows = [(k, f"v{k}", "bar azul", -8.0, -34.0) for k in range(3_000)] + [(9_000 + k, f"w{k}", f"loja numero {k:04}", -8.0, -34.0) for k in range(3_000)]
    assert groups(spark, rows) == {k: 0 for k in range(3_000)}


def test_components_of_a_chain_in_any_order(spark, monkeypatch):
    n, rng = 3_000, random.Random(2)
    names = list(range(n))
    rng.shuffle(names)
    edges = [(names[k], names[k + 1]) for k in range(n - 1) if k % 1000 != 999] + [(5, 5), (names[0], names[1])]
    made = counted(monkeypatch)
    got = {r.node: r.component for r in graph.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: min(names[b : b + 1000]) for b in range(0, n, 1000) for x in names[b : b + 1000]}
    assert got == want and len(made) <= 40
    assert graph.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_discovered(rows):
    ids, names, out = set(), set(), set()
    for place, i, n in sorted(rows):
        if (i or n) and not (i and i in ids) and not (n and n in names):
            out.add(place)
            ids |= {i} if i else set()
            names |= {n} if n else set()
    return out


def test_discovered_equals_brute_force_and_survives_chains(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, "", *map(str, range(40))]), rng.choice([None, "", *map(str, range(30))])) for k in range(400)]
    rows += [(1_000 + k, f"c{(k + 1) // 2}", f"d{k // 2}") for k in range(4_000)]  # each row shares its id or its name with the next
    made = counted(monkeypatch)
    got = {r.place for r in posts.discovered(spark.createDataFrame(rows, "place long, venue_id string, name string")).collect()}
    assert got == plain_discovered(rows) and len(made) <= 60
