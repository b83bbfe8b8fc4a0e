import math
import re

import corpus_pipeline as P
import duckdb
import pytest
from pyspark.sql import functions as F

from agora_spark.llm import mixing as M
from agora_spark.llm import queries as Q


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.op9_mixing(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r for r in con.execute(M.oracle()).fetchall()}
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r.doc_id]
        assert (r.n_tokens, r.source_level, r.lang_level, r.topic, r.kept, r.copies) == (w[1], w[2], w[3], w[4], w[7], w[8])
        assert math.isclose(r.weight, w[5], abs_tol=2e-6) and math.isclose(r.probability, w[6], abs_tol=2e-6)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


def test_marginals_meet_their_targets_and_the_fraction(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = M.mix(docs, rounds=60, fraction=0.4).cache()
    total, drawn = out.agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("probability"))).first()
    assert drawn / total == pytest.approx(0.4, abs=1e-6)
    for name, levels, shares in M.Targets().dimensions():
        column = "topic" if name == "topic" else f"{name}_level"
        mass = {r[0]: r[1] / total for r in out.groupBy(column).agg(F.sum(F.col("n_tokens") * F.col("weight"))).collect()}
        there = sum(s for x, s in zip(levels, shares) if x in mass)
        for x, s in zip(levels, shares):
            if x in mass:
                assert mass[x] == pytest.approx(s / there, abs=1e-4), x


def test_odd_rows(spark):
    rows = [(1, None, "en", "src0", 1), (None, "", None, None, 1), (3, "a b", None, "new", 1), (3, "a b", None, "new", 1), (4, "w " * 50_000, "xx", "src1", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    got = M.mix(df, fraction=1.0, keep=["doc_id", "text"]).collect()
    assert len(got) == 5 and all(r.kept for r in got if r.n_tokens)
    assert [r.n_tokens for r in got if r.doc_id == 4] == [50_000]
    assert M.mix(df.limit(0)).collect() == []
    assert [r.probability for r in M.mix(df.where("doc_id = 1")).collect()] == [1.0]


def test_copies_meet_the_targets_where_one_of_each_cannot(spark):
    dims = M.Targets().dimensions()
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    for fraction in (P.FRACTION, 0.5):
        out = M.mix(docs, fraction=fraction).cache()
        total, drawn = out.agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("copies"))).first()
        assert drawn / total == pytest.approx(fraction, rel=0.03)
        for name, levels, shares in dims:
            column = "topic" if name == "topic" else f"{name}_level"
            got = {r[0]: r[1] / drawn for r in out.groupBy(column).agg(F.sum(F.col("n_tokens") * F.col("copies"))).collect()}
            there = sum(s for x, s in zip(levels, shares) if x in got)
            for x, s in zip(levels, shares):
                if x in got:
                    assert got[x] == pytest.approx(s / there, abs=0.02, rel=0.15), (fraction, x)
        off = out.where(F.abs(F.col("copies") - F.col("weight") * fraction) >= 1).where("n_tokens > 0")
        assert off.count() == 0
        out.unpersist()


def test_the_stage_repeats_rows_to_its_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = P.mix_sources(spark, docs, "/root/testdata/sf0.1")
    assert rows.columns == docs.columns
    topic = M.topic_of(F.coalesce("text", F.lit("")))
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    got = rows.groupBy(topic.alias("topic")).agg(F.sum(tokens).alias("n")).collect()
    total = sum(r.n for r in got)
    for r in got:
        assert r.n / total == pytest.approx(M.Targets().topic[r.topic], abs=0.02, rel=0.15), r.topic
    source = {r[0]: r[1] / total for r in rows.groupBy("source").agg(F.sum(tokens)).collect()}
    assert source["src0"] == pytest.approx(0.15, abs=0.015)


def test_rows_without_tokens_are_not_repeated(spark):
    rows = [(k, "", "en", "src0") for k in range(20)] + [(20, "a b", "en", "src0"), (21, "w " * 900, "de", "src1")]
    got = M.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), fraction=0.9).collect()
    assert all(r.copies == r.kept for r in got if r.n_tokens == 0)
    assert [r.copies for r in got if r.doc_id == 20][0] > 1
