import hashlib
import random
import re

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from agora_spark.llm import queries as Q
from agora_spark.llm import winnow as W


def brute(gram_hashes, w):
    """Positions by the definition."""
    out = []
    n = len(gram_hashes)
    for a in range(max(1, n - w + 1) if n else 0):
        window = gram_hashes[a : a + w]
        out.append(a + max(i for i, h in enumerate(window) if h == min(window)))
    return sorted(set(out))


def test_marks_equal_the_definition(spark):
    rng = random.Random(4)
    texts = [None, "", " \n", "one", "a b c d", "a b c d e", " a  b\tc\x0bd\re\nf ", "x " * 50] + [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 60))) for _ in range(60)] + ["word " * 9_000 + "end"]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, marks int").select("doc_id", "text", F.col("marks").alias("_key"))
    for k, w in ((5, 4), (3, 5), (2, 1)):
        out = W.with_marks(df, "text", "m", k, w).select("doc_id", F.transform("m", W.mark_hash).alias("h"), F.transform("m", W.mark_position).alias("p"))
        every = W.with_marks(df, "text", "m", k, 1).select("doc_id", F.transform("m", W.mark_hash).alias("h"), F.transform("m", W.mark_position).alias("p"))
        grams = {r.doc_id: r.h for r in every.collect()}
        for r in out.collect():
            words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
            assert len(grams[r.doc_id]) == (max(1, len(words) - k + 1) if words else 0)
            assert r.p == brute(grams[r.doc_id], w), (k, w, texts[r.doc_id])
            assert r.h == [grams[r.doc_id][p] for p in r.p]
        same = {}
        for t, d in zip(texts, range(len(texts))):
            words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            for p, h in enumerate(grams[d]):
                assert same.setdefault((k, tuple(words[p : p + k])), h) == h


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for i, (d, t) in enumerate(rows):
        t, after = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        yield d, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()]
    got = {r.doc_id: r for r in Q.op8_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for d, n, s in expected(rows):
        assert (got[d].n_chars, got[d].edited_sha256) == (n, s)
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    by_text = {}
    for d, t in rows:
        assert by_text.setdefault(t, got[d].fingerprint) == got[d].fingerprint
    assert len(set(by_text.values())) == len(by_text)
    long = [got[d] for d, t in rows if len(t) > 1000]
    assert sum(r.near_edited > 0.15 for r in long) > 0.9 * len(long)
    plan = Q.op8_fingerprints(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_next_row_over_blocks_ties_and_nulls(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(40)]), rng.choice([None, "", "t%d x" % rng.randint(0, 30)])) for _ in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    real = W.with_next.__defaults__
    try:
        for per in (1, 7, 1000):
            W.with_next.__defaults__ = (per, *real[1:])
            got = sorted((str(r.doc_id), r.n_chars, r.edited) for r in W.edited_fingerprints(df).select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited")).collect())
            assert got == sorted((str(d), n, s) for d, n, s in expected(rows)), per
            assert W.edited_fingerprints(df.limit(0)).collect() == []
    finally:
        W.with_next.__defaults__ = real
