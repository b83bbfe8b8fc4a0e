import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from agora_spark.llm import bpe
from agora_spark.llm import queries as Q

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(text):
    points = np.frombuffer((text + "\n").encode("utf-32-le"), np.uint32)
    start = np.flatnonzero(bpe.boundaries(bpe.symbols(points, np.array([len(text)]))))
    return [text[a:b] for a, b in zip(start, start[1:])]


def test_boundaries_equal_the_pattern():
    rng = random.Random(5)
    parts = ["'s", "'", "'re", "'ve", "'ll", "'l", "s", "re", " ", "  ", "\n", "\t", " ", "　", "a", "É", "1", "²", "!", "!'", "\x1c", "語", "\U0001f600", "́", "'S", "r", "v", "d", "m", "t"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert cut(text) == regex.findall(public_tokenizers.PATTERN, text), repr(text)
    for text in ("a" * 3000, "'" * 2000 + "s", "!" * 700 + "'s" * 900 + " x", " " * 1500 + "x", "\n" * 1111, "'s" * 1000 + "'ll" * 1000):
        assert cut(text) == regex.findall(public_tokenizers.PATTERN, text)


def test_merges_and_rows_equal_the_library(spark, library):
    rng = random.Random(7)
    texts = [None, "", " ", "<|endoftext|>", "a" * 5000, "".join(rng.choice("abcde") for _ in range(20_000)), "é" * 999, "\x00\x01", "語" * 300, "it's we'll 'S", "x  \n\n y ", "dup", "dup"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    enc = bpe.encode_texts(df, RANKS, offsets=True)
    back = {r.doc_id: r.decoded for r in bpe.decode_ids(enc, RANKS).collect()}
    for r in enc.collect():
        want = library.encode_ordinary(texts[r.doc_id] or "")
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == want and r.n_tokens == len(want)
        assert np.frombuffer(r.ends, "<u4").tolist() == np.cumsum([len(library.decode_single_token_bytes(k)) for k in ids]).tolist()
        assert bytes(back[r.doc_id]).decode() == (texts[r.doc_id] or "")
    assert bpe.encode_texts(df.limit(0), RANKS).collect() == []


def test_query_equals_the_library(spark, sf_dir, library):
    import pyarrow.parquet as pq

    got = {r.doc_id: r for r in Q.op6_byte_bpe(spark, sf_dir).collect()}
    for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist():
        ids = library.encode_ordinary(r["text"] or "")
        x = got.pop(r["doc_id"])
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert not got


def test_forgetting_the_cache_changes_nothing(library):
    small = bpe.Encoder(RANKS, keep=3)
    texts = ["one two three four", "five six seven", "one two"] * 3
    for t in texts:
        ids, n = small.encode([t, ""])
        assert ids.tolist() == library.encode_ordinary(t) and n.tolist() == [len(ids), 0]
