import random
import re

import pyarrow as pa
import pyarrow.parquet as pq

from agora_spark.llm import ngram_join as N
from agora_spark.llm import queries as Q


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def set_of(text, width=4):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, percent=85):
    sets = [(d, set_of(t)) for d, t in rows]
    index = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (_, s) in enumerate(sets):
        counts = {}
        for g in s:
            for j in index[g]:
                if j < i:
                    counts[j] = counts.get(j, 0) + 1
        for j, both in counts.items():
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                parent[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            best[find(i)] = min(d, best.get(find(i), d))
    return sorted((str(d), len(s), str(best.get(find(i)) if s else d)) for i, (d, s) in enumerate(sets))


def said(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_sets_equal_the_definition():
    texts = [None, "", " \n", "one", "A b\tC", "a b c", "a b c d", "a b c d a b c d", "É a\x0bb\x0cc d", "ab c d e", "a bc d e", " lead a b c d trail "]
    sets = N.shingle_sets(pa.array(texts, pa.string()), 4)
    seen = {}
    for t, s in zip(texts, sets):
        want = set_of(t)
        assert len(s) == len(want)
        assert seen.setdefault(s.tobytes(), want) == want
    assert len(seen) == len({frozenset(set_of(t)) for t in texts})
    assert [s.tobytes() for s in N.shingle_sets(pa.array(["x" * 10, "a b c d"]), 4)][1] == sets[6].tobytes()


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    assert said(Q.op10_ngram_join(spark, sf)) == brute(rows)


def test_chains_near_the_bound_and_odd_rows(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows, now = [], list(base)
    for i in range(60):  # a chain: neighbours link, far ones do not
        rows.append((500 - i, " ".join(now)))
        now = now[1:] + [f"x{i}"] if i % 2 else now[2:] + [f"y{i}", f"z{i}"]
    for i in range(150):  # near copies with some words changed
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(60)] = f"c{rng.randrange(50)}"
        rows.append((1000 + i, " ".join(w)))
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(2000 + i, passage + " " + " ".join(f"q{i}_{j}" for j in range(rng.randint(5, 200)))) for i in range(60)]
    rows += [(3000 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))) for i in range(150)]
    rows += [(None, " ".join(base)), (None, "alone here no id at all"), (None, None), (1, None), (1, ""), (7, "dup row words here"), (7, "dup row words here"), (9, "long " * 30_000), (8, "long " * 30_001)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int").repartition(5)
    assert said(N.link_documents(df)) == brute(rows)
    assert N.link_documents(df.limit(0)).collect() == []
