import hashlib
import random

import pyarrow.parquet as pq

from agora_spark.llm import line_dedup as L
from agora_spark.llm import queries as Q


def grams(line):
    return {line[i : i + L.SHINGLE] for i in range(max(1, len(line) - L.SHINGLE + 1))}


def brute(rows, percent=80):
    """All pairs of different lines by exact likeness; (id, text, lines, removed) of each row."""
    nodes = sorted({n for _, t in rows for line in (t or "").split("\n") if (n := L.normal(line))})
    sets = [grams(n) for n in nodes]
    index, parent = {}, list(range(len(nodes)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        counts = {}
        for g in s:
            for j in index.get(g, ()):
                counts[j] = counts.get(j, 0) + 1
            index.setdefault(g, []).append(i)
        for j, both in counts.items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    at = {n: find(i) for i, n in enumerate(nodes)}
    first = {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        for k, line in enumerate((t or "").split("\n")):
            if n := L.normal(line):
                first.setdefault(at[n], (d, t, k))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        keep = [x for k, x in enumerate(lines) if not L.normal(x) or first[at[L.normal(x)]] == (d, t, k)]
        out.append((d, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def test_shingles_equal_the_definition():
    lines = ["a", "abcdefg", "abcdefgh", "abcdefghi", "é" * 20, "xabcdefgh"]
    sets = L.shingle_sets(lines)
    assert [len(s) for s in sets] == [len(grams(x)) for x in lines]
    assert set(sets[2]) < set(sets[3]) and set(sets[2]) < set(sets[5])


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text_sha256) for r in Q.op3_line_dedup(spark, sf).collect()}
    want = {d: (n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, gone in brute(rows)}
    assert set(got) == set(want)
    wrong = [d for d in want if got[d] != want[d]]
    assert len(wrong) <= 0.01 * sum(w[1] > 0 for w in want.values()), wrong[:5]


def test_near_lines_and_odd_rows(spark):
    rng = random.Random(3)
    base = "the quick brown fox jumps over the lazy dog near the old river bank at night"
    near = []
    for i in range(60):
        c = list(base)
        c[rng.randrange(len(c))] = rng.choice("xyz")
        near.append("".join(c))
    rows = [(i, f"{x}\nown line number {i * 7919} of this document\n\nshort") for i, x in enumerate(near)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, base), (None, "only here, without any id at all"), (50, "twice the same row and id\nshort"), (50, "twice the same row and id\nshort"), (103, "A  TAB\tline with blanks and capitals"), (104, "a tab line with blanks and capitals"), (105, "v" * 100_000), (106, "v" * 100_001 + "\nx" * 3)]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_removed int").repartition(3)
    got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in L.dedup_lines(df).collect())
    assert got == sorted((str(d), t, n, g) for d, t, n, g in brute(rows))
    assert L.dedup_lines(df.limit(0)).collect() == []
