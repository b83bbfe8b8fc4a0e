import numpy as np
import pyarrow.parquet as pq

from agora_spark.llm import queries as Q
from agora_spark.llm import toxicity as T


def test_subwords_are_the_n_grams_of_each_word():
    words = ["ab", "é", "abcdef"]
    at, n = T.subwords(words, 1 << 30)
    grams = [[f"<{w}>"[i : i + k] for k in T.SIZES for i in range(len(w) + 3 - k)] for w in words]
    assert n.tolist() == [len(g) + 1 for g in grams]
    again, _ = T.subwords(["abcdef"], 1 << 30)
    assert sorted(at[-n[-1] :]) == sorted(again)
    assert len(set(T.subwords(["abcdefg"], 1 << 30)[0]) & set(again)) >= 6


def test_held_out_accuracy_and_misspellings(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in Q.op5_toxicity(spark, sf).collect()}
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    assert len(got) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    part = [(got[d].predicted, t) for d, t in toxic.items() if got[d].held_out]
    hit, said, real = sum(p * t for p, t in part), sum(p for p, _ in part), sum(t for _, t in part)
    print("held out: precision", hit / said, "recall", hit / real, "of", real)
    assert hit / said > 0.75 and hit / real > 0.75  # this table has labels that no word explains

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = T.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"), learn=~Q.held_out())
    clean = [t for t in pq.read_table(f"{sf}/documents.parquet").column("text").to_pylist()[:400] if 300 < len(t) < 3000][:40]
    odd = [c[:150] + " you stupiid idiots and loosers " + c[150:] for c in clean]
    before, after = T.Scorer(model).scores(clean), T.Scorer(model).scores(odd)
    print("misspelt", np.round(after[:10], 2), "clean", np.round(before[:10], 2))
    after = after[before < 0.3]
    assert len(after) > 20 and (after >= 0.3).mean() > 0.9


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "idiot " * 20_000, "s"), (3, "idiot", "s"), (None, "fine words", "s"), (5, "\x00 ", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, None), (9, 1), (None, 1), (2, 0)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    got = T.score(docs, model).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    empty = [r.score for r in got if r.doc_id in (1, 2)]
    assert empty[0] == empty[1]
    assert T.score(docs.limit(0), model).collect() == []
    none = T.fit(docs, labels.limit(0))
    assert {r.score for r in T.score(docs, none).collect()} == {0.0} or max(r.score for r in T.score(docs, none).collect()) < 1e-9
