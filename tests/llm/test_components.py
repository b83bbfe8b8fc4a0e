import random

from agora_spark.llm.components import connected


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def test_components(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(100, 160)]
    zigzag = [(1000 + (i * 37) % 101, 1000 + ((i + 1) * 37) % 101) for i in range(100)]
    some = [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(150)]
    star = [(5000, i) for i in range(5001, 5200)]
    edges = path + zigzag + some + star + star[:9]
    df = spark.createDataFrame([*edges, (None, 1), (7, 7)], "a long, b long").repartition(3)
    got = {r.node: r.component for r in connected(df).collect()}
    assert got == {k: v for k, v in brute([e for e in edges if e[0] != e[1]]).items()}
    assert connected(df.limit(0)).collect() == []
