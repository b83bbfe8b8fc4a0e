"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

from agora_spark.llm import spelling


def plain_counts(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def plain_variants(n):
    form, out = {}, {}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def as_dict(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def some_docs(seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abéß", k=rng.randrange(5, 9))) for _ in range(40)]
    return [(k, " ".join(rng.choice(stems) + rng.choice(["", "", "", "a", "X9", "-"]) for _ in range(60))) for k in range(80)]


def test_equals_brute_force(spark):
    rows = some_docs(1)
    got = as_dict(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain_variants(plain_counts(rows))
    assert any(f and f != r for f, r, *_ in got.values()) or any(f for f, *_ in got.values())


def test_small_shards_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD_WORDS", 7)
    monkeypatch.setattr(spelling, "SHARD_CHARS", 40)
    rows = some_docs(2)
    assert as_dict(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == plain_variants(plain_counts(rows))


def test_chains_of_forms_end_at_their_root(spark):
    text = " ".join(["abcdefg"] * 5 + ["abcdefgh"] * 25 + ["abcdefghi"] * 125 + ["abcdefghij"] * 625)
    rows = [(1, text)]
    got = as_dict(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == plain_variants(plain_counts(rows))
    assert {r for _, r, *_ in got.values()} == {"abcdefghij"}


def test_odd_rows(spark):
    rows = [(None, "Élan ÀÉÎÕÜÿ " * 6), (1, None), (2, ""), (3, "x" * 50_000 + " "), (3, ("y" * 70 + " ") * 5), (3, ("y" * 71 + " ") * 25), (4, "ÀÉÎÕÜ× àéîõüÿ ÀÉÎÕÜY " * 5), (4, "ÀÉÎÕÜ× àéîõüÿ ÀÉÎÕÜY " * 5)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long")
    assert as_dict(spelling.variants(df)) == plain_variants(plain_counts(rows))
    assert spelling.variants(df.limit(0)).count() == 0


def test_trie_finds_all_words_one_edit_away():
    rng = random.Random(4)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(1, 7))).encode() for _ in range(400)})
    trie = spelling.Trie.unpack(spelling.Trie.pack(words, list(range(len(words)))))
    assert trie.words == words
    for w in [*words, b"", b"zzz", b"abcabcabc"]:
        found = trie.near(w)
        assert len(found) == len(set(found))
        assert {trie.words[k] for k in found} == {v for v in words if one_edit(w.decode(), v.decode())}


def test_real_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert as_dict(spelling.variants(docs)) == plain_variants(plain_counts(rows))
