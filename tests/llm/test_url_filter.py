import fnmatch
import random
import re

from agora_spark.llm import url_filter as U


def test_automaton_equals_a_regex_for_each_glob():
    rng = random.Random(1)
    globs = ["".join(rng.choice("ab*?#/") for _ in range(rng.randint(0, 9))) for _ in range(70)]
    texts = ["".join(rng.choice("abc#/é") for _ in range(rng.randint(0, 14))) for _ in range(300)] + [""]
    got = U.Automaton(globs).match(texts)
    for j, g in enumerate(globs):
        want = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g) + r"\Z", re.S)
        assert [bool(want.match(t)) for t in texts] == got[:, j].tolist(), g


def test_cases(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://example.org/en/2",
            "http://notorg/", "http://a.com/fr/", "http://a.com?/fr/", "http://xcom/de/", "ftp://b.com/de/#/fr/", "http://x.net/a/login?q", "x" * 50_000,
            "http://y.net/" + "é" * 20_000, "http://É.org/", "a://b://c.org/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: r for r in U.judge_urls(df).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(13)] == [
        ("", "", None, "block"), ("", "", None, "block"), ("", "", None, "block"), ("", "", None, "block"),
        ("www.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"),
        ("notorg", "/", None, "allow"), ("a.com", "/fr/", "com/fr/", "allow"), ("a.com", "", None, "allow"), ("xcom", "/de/", None, "allow"),
        ("b.com", "/de/", "com/de/", "block"), ("x.net", "/a/login", None, "block"),
    ]
    assert got[14].path == "/" + "é" * 20_000 and got[15].host == "É.org" and got[16].host == "b:"
    assert U.judge_urls(df.limit(0)).collect() == []


def test_long_rule_sets_span_words(spark):
    rules = [U.HostRule("block", f"host{i}.test", f"/p{i}/") for i in range(40)]
    df = spark.createDataFrame([(i, f"https://a.host{i}.test/p{i}/x") for i in range(45)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in U.judge_urls(df, host_rules=rules, block_globs=()).collect()}
    assert got == {i: (f"host{i}.test/p{i}/", "block") if i < 40 else (None, "allow") for i in range(45)}
    assert fnmatch.fnmatchcase("a", "?")
