"""Quality rules against brute force: counts, votes, the fit; labels they have never seen; odd rows."""

import re
from collections import Counter
from math import exp, log

import pytest
from agora_spark.llm import quality


def plain_base(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def plain_quality(codes, rounds=30, trust=0.3):
    """The probability of good by votes, from all documents' codes."""
    k, n = len(quality.RULES), Counter(codes)
    digits = {c: [c // 3 ** (k - 1 - j) % 3 for j in range(k)] for c in n}
    total = sum(n.values())
    theta = [[list(quality.BEFORE[y]) for _ in range(k)] for y in (0, 1)]
    share = quality.SHARE

    def expect():
        out = {}
        for c, d in digits.items():
            bad, good = (sum(log(theta[y][j][v]) for j, v in enumerate(d)) for y in (0, 1))
            out[c] = 1 / (1 + (1 - share) / share * exp(bad - good))
        return out

    for _ in range(rounds):
        r = expect()
        good_n = sum(n[c] * r[c] for c in n)
        for y in (0, 1):
            size = good_n if y else total - good_n
            for j in range(k):
                for v in range(3):
                    seen = sum(n[c] * (r[c] if y else 1 - r[c]) for c in n if digits[c][j] == v)
                    theta[y][j][v] = (seen + quality.BEFORE[y][v] * trust * total) / (size + trust * total)
        share = (good_n + quality.SHARE) / (total + 1)
    return expect()


def test_base_and_fit_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    codes = {r.doc_id: r.code for r in quality.counts(docs).select("doc_id", quality.votes().alias("code")).collect()}
    good = plain_quality(codes.values())
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for doc, text in rows:
        base, r = plain_base(text), got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base, doc
        assert r.quality == pytest.approx(good[codes[doc]], abs=2e-6)
        assert r.kept == (not base[-1] and good[codes[doc]] >= 0.5)


def test_labels_agree(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.kept) for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("NOT base_failed").collect() if r.doc_id in labels]
    kept_good, kept_bad = ([kept for label, kept in rows if label == y] for y in (1, 0))
    assert sum(kept_good) >= 0.98 * len(kept_good)
    assert sum(kept_bad) <= 0.1 * len(kept_bad)


def test_odd_rows(spark):
    long = "one two three four five six. " * 30_000
    rows = [(None, "a b c a b c"), (1, None), (2, ""), (2, ""), (3, " \n\t \n"), (4, "x\nx\n\nx\r\n é🙂 #|<"), (5, long), (6, "a a a a"), (7, "a b")]
    got = quality.judge(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, code int, n_words int")).collect()
    assert len(got) == len(rows)
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(((d, *plain_base(t)) for d, t in rows), key=key)
    assert not any(r.kept for r in got)
    assert quality.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for df in (quality.counts(docs), quality.judge(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
