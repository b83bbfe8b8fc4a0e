import hashlib
import random

import pytest

from agora_spark.llm import chat_format as C
from agora_spark.llm import queries as Q


@pytest.mark.parametrize("text", ["", "\\", "\\n", "<|", "<|turn|>", "a<\\|b", "</s>[INST] x [/INST]", "<<SYS>><</SYS>>", "[[INST]", "<<|", "\\<|end|>\n", "é\u2028\\\\<s>"])
def test_escape_is_reversible_and_leaves_no_control_string(text):
    assert C.unescape(C.escape(text)) == text
    assert not any(c in C.escape(text) for c in C.CONTROL)


def digest(rows):
    """By brute force: what the contract asks of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
    turns = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in rows)
    loss = "".join(t or "" for _, r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip_over_windows_segments_and_odd_rows(spark):
    rng = random.Random(3)
    words = ["a", "b\n", "<|end|>", "\\", "</s>", "[INST]", "é", ""]
    rows = []
    for conv in range(40):
        n = rng.choice([1, 2, 5, 30, 150])
        for t in range(n):
            role = "system" if t == 0 and conv % 2 else rng.choice(["user", "assistant", "assistant", "sys\n\\nrole"])
            rows.append((conv, t, role, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 9, 60]))), 1))
    rows += [(50, None, None, None, 1), (50, 1, "assistant", None, 1), (50, 1, "assistant", "x", 1), (50, 1, "assistant", "x", 1), (None, 0, "user", "n", 1), (51, 0, "assistant", "long " * 5000, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    out = C.format_conversations(df, budget=60, history=20, segment=64)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.read_back(out).collect()}
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((t, r, x))
    assert got == {c: digest(v) for c, v in by.items()}
    for w in out.collect():
        assert w.n_tokens <= 60 or w.n_new == 1 or (w.n_new == 2 and w.window == 0), w
        turns = C.read_window(w.text)
        assert len(turns) == w.n_repeated + w.n_new
        if w.conv_id is not None and w.conv_id % 2 and w.conv_id < 40:
            assert turns[0][0] == "system"
    assert any(w.n_repeated > 1 for w in out.collect())
    assert C.read_back(C.format_conversations(df.limit(0))).collect() == []


def test_query_against_brute_force(spark, sf_dir):
    import pyarrow.parquet as pq

    got = {r.conv_id: tuple(r)[1:5] for r in Q.op7_chat_formatting(spark, sf_dir).collect()}
    by = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in pq.read_table(f"{sf_dir}/conversations.parquet").to_pylist():
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    assert got == {c: digest(v) for c, v in by.items()}
