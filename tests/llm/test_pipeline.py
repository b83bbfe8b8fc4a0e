import re

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from agora_spark.llm import bpe
from agora_spark.llm import line_dedup as L
from tests.llm.test_line_dedup import brute as brute_lines


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = P.drop_toxic(spark, docs, sf_dir)
    rows = clean.collect()
    assert clean.columns == docs.columns and 0 < len(rows) <= docs.count()
    frame = spark.createDataFrame(rows, docs.schema)

    once = {r.doc_id: r for r in P.drop_repeated_lines(spark, frame, sf_dir).collect()}
    want = {d: (t, gone) for d, t, _, gone in brute_lines([(r.doc_id, r.text) for r in rows])}
    assert {d for d, (t, gone) in want.items() if not gone or L.normal(t.replace("\n", " "))} == set(once)
    assert all(r.text == want[d][0] and (not want[d][1] or r.n_chars == len(r.text)) for d, r in once.items())

    frame = spark.createDataFrame(list(once.values()), docs.schema)
    near = {r.doc_id: r.text for r in P.drop_near_copies(spark, frame, sf_dir).collect()}
    sets = {d: shingles(r.text, 5) for d, r in once.items()}
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(near) == {d for d in ids if find(d) == d}


def test_run_and_stage_columns(spark, sf_dir):
    assert [name for name, _ in P.STAGES] == ["toxicity", "line_dedup", "near_copies", "mixing", "encoding"]
    out = P.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids"]
    vocabulary = bpe.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = out.collect()
    assert len(rows) > 50 and out.select(F.max("n_tokens")).first()[0] > 100
    for r in rows:
        text = vocabulary.decode(np.frombuffer(r.ids, "<u4"))[0].tobytes().decode()
        assert r.n_tokens == len(r.ids) // 4
        left = texts[r.doc_id].split("\n")
        assert all(line in left for line in text.split("\n"))


def test_odd_rows_pass_the_stages(spark, sf_dir):
    long = "word " * 40_000
    rows = [(1, None), (2, ""), (None, "no id here, but a text of more than a few words"), (3, "the same row twice, word by word"), (3, "the same row twice, word by word"), (4, long), (5, long + "end"), (6, "\n\n"), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", None, None, 1, "x") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, copies int, node string").repartition(3)
    for start in (docs, docs.limit(0)):
        now = start
        for _, stage in P.STAGES[:-1]:
            now = stage(spark, now, sf_dir)
            assert now.columns == docs.columns
            now = spark.createDataFrame(now.collect(), docs.schema)
        out = {(r.doc_id, r.n_tokens) for r in P.STAGES[-1][1](spark, now, sf_dir).collect()}
        assert {d for d, _ in out} <= {None, 1, 2, 3, 4, 5, 6}  # mixing draws among them
        assert start is not docs or {1, 2} <= {d for d, n in out if not n}
