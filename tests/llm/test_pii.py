import hashlib
import random
import re

import pyarrow.parquet as pq

from agora_spark.llm import pii as P
from agora_spark.llm import queries as Q

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def say(spans):
    return ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(9)
    parts = ["a", "@", ".", "b-c", "1", "22", "256", "255", "+", "+1 ", " ", "(", ")", "-", "_", "%", "é", "\U0001f600", "4111 1111 1111 1111", "10.0.0.1", "x@y.co", "\n", "0000000001"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    texts += [None, "", "1" * 30_000, "a" * 30_000, "a@" * 5_000, "a@b" + ".c" * 20_000, "1.1.1.1 " * 3_000, "a.b@c.d_e@f.g", "1.2.3.4.5.6.7.8", "+1" + " " * 9_000, "x@y.zz,é" * 700]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, spans int").select("doc_id", "text", "spans").repartition(4)
    for r in P.find_personal_data(df).collect():
        want = brute(texts[r.doc_id])
        assert [tuple(s) for s in r.base] == want, texts[r.doc_id][:80]
        assert set(want) <= {tuple(s) for s in r.spans}
    assert P.find_personal_data(df.limit(0)).collect() == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in Q.op1_personal_data(spark, sf).collect()}
    rows = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    assert len(got) == len(rows)
    for r in rows:
        want, x = brute(r["text"]), got[r["doc_id"]]
        assert x.base_sha256 == hashlib.sha256(say(want).encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)]
        assert set(say(want).split(",")) <= set(x.spans.split(","))
    plan = Q.op1_personal_data(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_the_method_adds_loose_forms_and_leaves_clean_text(spark):
    good = ["mail jo.e [at] example [dot] com now", "call (415) 555-2671 today", "card 4111_1111_1111_1111 ok", "tel 415-555-2671", "server 2001:db8:0:1:1:1:1:1 is up"]
    sure = [f"write to u{i}@example.com or phone +1 (415) 555-{1000 + i}, card 4111 1111 1111 1111, ip 10.0.0.{i}" for i in range(60)]
    bad = ["version 300.1.2.999 is out", "order 1234 5678 1234 5678", "plain words only", "in 1999 there were 12 of 24", "release 1.2.3"]
    texts = sure + good + bad
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in P.find_personal_data(df).collect()}
    for i in range(60, 65):
        assert len(got[i]) == 1, (texts[i], got[i])
    for i in range(65, 70):
        assert got[i] == [], (texts[i], got[i])
