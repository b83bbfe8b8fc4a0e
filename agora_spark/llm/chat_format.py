"""Chat formatting: budgeted, turn-aligned training windows with a loss mask.

Turns are counted in tokens; prefix sums of the counts choose spans of whole turns that fit the
budget. Each window repeats the system turn and, as far as `history` tokens go, the turns before it.
Only assistant texts that the window shows for the first time are under the loss mask, so each is
learnt once. Control strings inside texts are escaped reversibly; read_windows() undoes it.

The turn number is the place in the conversation (0, 1, ...). A conversation is cut into segments of
`segment` turn numbers, which are formatted apart: a segment gets the system turn and as many turns of
the segment before as the history can hold, but no window spans two. So one endless conversation spreads over many tasks.

Defined results: null texts and roles are empty; a null turn comes first; turns with the same number
are ordered by role and text, and repeated rows are repeated turns. A null conv_id is a conversation
of its own. A turn over the budget makes a window by itself, whole, without history. Empty tables
give empty tables. Only the four named columns are read; others can have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora_spark.llm.common import lean

TURN, END = "<|turn|>", "<|end|>"
#: Tokens that a turn costs besides its text.
TURN_TOKENS = 4
#: Strings that models read as markup. In a text each gets a backslash after its first character.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.S)
_BLOCK = re.compile(re.escape(TURN) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)
WINDOWS = "conv_id long, segment long, window int, text string, loss array<struct<start:int,end:int>>, n_repeated int, n_new int, n_tokens long"


def escape(text: str) -> str:
    """Text without control strings; unescape() gives it back."""
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template has it, and the span of its text."""
    head = TURN + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + END + "\n", len(head), len(head) + len(body)


def read_window(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn of a window."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _BLOCK.finditer(text)]


def spans(tokens: np.ndarray, n_before: int, system: int, budget: int, history: int) -> Iterator[tuple[int, int, int]]:
    """(first repeated, first new, end) of each window over the turns; the first n_before turns are history only."""
    total = np.concatenate(([0], np.cumsum(tokens)))
    at = n_before
    while at < len(tokens):
        back = min(int(np.searchsorted(total, total[at] - history)), at)  # as many turns before as fit
        end = int(np.searchsorted(total, total[back] + budget - system, "right")) - 1
        if end <= at:  # history leaves no room for the next turn
            back, end = at, max(at + 1, int(np.searchsorted(total, total[at] + budget - system, "right")) - 1)
        yield back, at, end
        at = end


def format_conversations(df: DataFrame, budget: int = 2048, history: int = 512, segment: int = 1024) -> DataFrame:
    """The windows of all conversations (columns of WINDOWS).

    budget and history count tokens (runs of word characters, and other characters that are not
    blank). n_repeated counts the turns at the window's start that an earlier window has shown.
    """
    tail = min(history // TURN_TOKENS, segment)  # no more turns than that fit in the history
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    at = F.coalesce(F.floor(F.col("turn") / segment), F.lit(0)).cast("long")
    rows = rows.withColumn("segment", at).withColumn("tokens", F.regexp_count("text", F.lit(r"\w+|[^\w\s]")).cast("long") + TURN_TOKENS)
    own = rows.withColumn("kind", F.lit(2))  # 0: system turn, 1: before the segment, 2: in it
    # The end of each segment is also history of the next one, if there is one.
    ends = rows.where(F.col("turn") % segment >= segment - tail).withColumns({"segment": F.col("segment") + 1, "kind": F.lit(1)})
    later = rows.where("segment > 0").select("conv_id", "segment").distinct()
    first = rows.groupBy("conv_id").agg(F.min(F.struct("turn", "role", "text", "tokens")).alias("first")).where("first.role = 'system'")
    system = later.join(first, later.conv_id.eqNullSafe(first.conv_id)).select(later.conv_id, "first.turn", "first.role", "first.text", "segment", "first.tokens", F.lit(0).alias("kind"))
    dealt = own.unionByName(ends).unionByName(system).select("conv_id", "segment", "kind", "turn", "role", "text", "tokens")
    dealt = dealt.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "kind", "turn", "role", "text")

    def close(conv, seg, turns: list) -> Iterator[tuple]:
        if not any(t[0] == 2 for t in turns):
            return  # history of a segment that does not exist
        lead = turns[:1] if turns[0][0] == 0 or (seg == 0 and turns[0][1] == "system") else []
        rest = turns[len(lead) :]
        repeated_lead = bool(lead) and lead[0][0] == 0
        tokens = np.array([t[3] for t in rest], np.int64)
        n_before = sum(t[0] == 1 for t in rest)
        cost = lead[0][3] if lead else 0
        cuts = list(spans(tokens, n_before, cost, budget, history)) or [(0, 0, 0)]
        for w, (back, new, end) in enumerate(cuts):
            shown = [*lead, *rest[back:end]]
            n_old = new - back + (1 if lead and (repeated_lead or w) else 0)
            parts, loss, place = [], [], 0
            for k, (_, role, text, _) in enumerate(shown):
                turn, a, b = render(role, text)
                if role == "assistant" and (k >= len(lead) + new - back or (k < len(lead) and not (repeated_lead or w))):
                    loss.append({"start": place + a, "end": place + b})
                parts.append(turn)
                place += len(turn)
            yield conv, seg, w, "".join(parts), loss, n_old, len(shown) - n_old, cost + int(tokens[back:end].sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_repeated", pa.int32()), ("n_new", pa.int32()), ("n_tokens", pa.int64())])
        key, turns, out, size = None, [], [], 0
        pack = lambda: pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in out], kind)
        for batch in batches:
            for conv, seg, what, _, role, text, n in zip(*(c.to_pylist() for c in batch.columns)):
                if turns and (conv, seg) != key:
                    for row in close(*key, turns):
                        out.append(row)
                        size += len(row[3])
                    turns = []
                    if size > 4_000_000:
                        yield pack()
                        out, size = [], 0
                key = (conv, seg)
                turns.append((what, role, text, n))
        if turns:
            out.extend(close(*key, turns))
        if out:
            yield pack()

    return dealt.mapInArrow(lean(run), WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows say, by conversation: counts and hashes of the turns and of the text under the loss mask.

    The windows of a conversation come in order and are hashed as they pass, so nothing is held but
    the hash states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        out, key, now = [], None, None
        done = lambda: out.append(dict(zip(names, (key, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4]))))
        for batch in batches:
            for conv, text, loss, n_old in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or conv != key:
                    if now is not None:
                        done()
                    key, now = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                under = {(x["start"], x["end"]) for x in loss}
                for k, (role, body, a, b) in enumerate(read_window(text)):
                    if k >= n_old:
                        now[0] += 1
                        now[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                    if (a, b) in under:
                        now[2] += len(body)
                        now[3].update(body.encode("utf-8", "surrogatepass"))
                now[4] += len(text)
            if len(out) > 5_000:
                yield pa.RecordBatch.from_pylist(out, kind)
                out = []
        if now is not None:
            done()
        if out:
            yield pa.RecordBatch.from_pylist(out, kind)

    rows = windows.select("conv_id", "segment", "window", "text", "loss", "n_repeated")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window").select("conv_id", "text", "loss", "n_repeated")
    return rows.mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
