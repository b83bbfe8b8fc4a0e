"""The search for the most alike names: shards, bounds, ties and points."""

import random

import pytest
from pyspark.sql import functions as F

from agora_spark.operators import likeness

WORDS = ["bar", "café", "do", "zé", "azul", "Mercado", "da", "encruzilhada", "boa viagem", "Parraxaxá", "recife", "32", "oficial", "-", "lua"]


def some(seed, n):
    rng = random.Random(seed)
    return sorted({" ".join(rng.choices(WORDS, k=rng.randrange(1, 5))) for _ in range(n)})


def forms(spark, names):
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", likeness._plain(F.col("name")), likeness.fold_ascii(F.col("name")), likeness.core(F.col("name")))
    return {r[0]: tuple(r[1:]) for r in rows.collect()}


@pytest.mark.parametrize("size", [5, 1 << 15])
def test_best_names_equal_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(likeness, "SHARD_NAMES", size)
    names, texts = some(1, 60), [*some(2, 40), "", "!!", "x" * 5000]
    by = forms(spark, names + texts)
    want = set()
    for t in texts:
        scores = sorted(((likeness.likeness(by[n], by[t]), n) for n in names), reverse=True)
        want |= {(t, n, s) for s, n in scores if s > 0 and s >= scores[1][0]}
    as_df = lambda x, c: spark.createDataFrame([(y,) for y in [*x, *x, None]], f"{c} string")
    got = likeness.best_names(as_df(texts, "text"), as_df(names, "name")).collect()
    assert {(r.text, r.name, r.exact) for r in got} == want and len(got) == len(want)
    if size > len(names):  # far from all names are compared
        assert sum({r.text: r.compared for r in got}.values()) < 0.5 * len(names) * len(texts)


def test_bounds_hold(spark):
    names, texts = some(3, 80), some(4, 30)
    by = forms(spark, names + texts)
    shard = likeness.Shard(names, [by[n] for n in names])
    for t in texts:
        bounds = shard.bounds(by[t][:2])
        for k, n in enumerate(names):
            assert bounds[k] >= likeness.likeness(by[n], by[t][:2]) - 1e-12


def test_core(spark):
    got = forms(spark, ["Bode do Nô Boa Viagem - Restaurante", "Bar do Zé", "Bar", "", None])
    assert [got[n][2] for n in ("Bode do Nô Boa Viagem - Restaurante", "Bar do Zé", "Bar", "", None)] == ["bodeno", "ze", "bar", "", ""]


def test_points_break_ties(spark):
    places = spark.createDataFrame([("p1", "Lua", 0.0, 0.0), ("p2", "Lua", 1.0, 1.0), ("p3", "Lua", None, None), ("p4", "Sol", 0.0, 0.0), ("p5", "Lua", 1.1, 1.0)], "place string, name string, lat double, lng double")
    said = spark.createDataFrame([(1, "Lua", 1.2, 1.0), (2, "Lua", None, None), (3, "@lua Lua", 1.0, 1.0), (4, None, 1.0, 1.0)], "event_id long, text string, lat double, lng double")
    got = {(r.event_id, r["rank"]): (r.place, r.score, r.linked) for r in likeness.ranked_links(said, places).collect()}
    assert got == {(1, 1): ("p5", 1.0, False), (1, 2): ("p2", 1.0, False), (2, 1): ("p1", 1.0, False), (2, 2): ("p2", 1.0, False)}
    assert likeness.ranked_links(said.limit(0), places).count() == 0 and likeness.ranked_links(said, places.limit(0)).count() == 0


def test_no_table_of_pairs_in_the_plan(spark, sf_dir):
    from agora_spark.plans import linking

    plan = linking.link_candidates_ranked(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and plan.count("NestedLoop") <= 2  # a count of parts joins as one row
