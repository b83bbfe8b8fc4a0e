import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from agora_spark.llm import ann
from agora_spark.llm import queries as Q


def brute(ids, vectors, queries, k):
    out = {}
    for q in queries:
        s = vectors @ vectors[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def collect(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_the_test_table(spark):
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pydict()
    ids, v = np.array(t["vec_id"]), np.array(t["embedding"], np.float32).astype(float)
    got = collect(Q.op2_nearest_vectors(spark, "/root/testdata/sf0.1"))
    want = brute(ids, v, np.flatnonzero(ids % 20 == 0), 20)
    assert set(got) == set(want)
    assert recall(got, want) >= 0.95
    exact = {(q, i): s for q in want for i, s in zip(ids.tolist(), v @ v[list(ids).index(q)])}
    assert all(abs(exact[q, i] - s) < 1e-12 for q, w in got.items() for i, s in w)


def test_uneven_norms_copies_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((600, 8)) * rng.exponential(1, (600, 1))
    v[100:300] = v[100]
    rows = [(i, x.tolist(), "x") for i, x in enumerate(v)]
    odd = [(1000, None, ""), (1020, [], ""), (1040, [0.0] * 8, ""), (1060, [float("nan")] + [1.0] * 7, ""), (1080, [None] + [1.0] * 7, ""), (1100, [float("inf")] + [1.0] * 7, ""), (None, [1.0] * 8, ""), (1120, [1.0, 2.0], ""), (1121, [3.0, 2.0], "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, score string")
    got = collect(ann.nearest(df, F.col("vec_id") % 20 == 0))
    want = brute(np.arange(600), v, range(0, 600, 20), 20)
    assert got.pop(1120) == [(1121, 7.0)]
    assert set(got) == set(want) and all(len(w) == 20 for w in got.values())
    assert recall(got, want) >= 0.95
    assert [i for i, _ in got[100]] == [i for i, _ in want[100]]  # ties to the smaller id
    assert collect(ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0)) == {}
    few = collect(ann.nearest(df.where("vec_id < 5"), F.col("vec_id") == 0))
    assert sorted(i for i, _ in few[0]) == [1, 2, 3, 4]


def test_few_rows_are_verified():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((10_000, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    index = ann.Index(v, 1.0, 2, 17)
    least = ann.threshold(len(index.lines), 0.1)
    rows, _, _ = index.search(v[:40], 21, least, 1.0, 1.03)
    near = [set(np.argsort(-(v @ q))[:21].tolist()) for q in v[:40]]
    assert sum(map(len, rows)) <= 0.2 * 40 * len(v)
    assert sum(len(w & set(r.tolist())) for w, r in zip(near, rows)) >= 0.9 * 40 * 21
