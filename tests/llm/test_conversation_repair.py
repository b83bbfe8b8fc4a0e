"""Conversation repair against brute force over whole conversations: all edits, not one block at a time."""

import hashlib
import random
import zlib

import pytest

from agora_spark.llm import conversation_repair as repair

KIND = "conv_id long, turn long, role string, text string"
BLANKS = set(" \t\n\x0b\x0c\r")


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        if d == 1:
            text = ""
        if d == 2:
            text = "".join(c for c in text if c not in ".!?")
        if d == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if d == 3 else 1)
    return out


def plain_edits(turns):
    """(cost, audit, repaired) by shortest ways that carry their whole audit: turns are (role, text, must go, truncated)."""
    follow = {0: "su", 1: "u", 2: "a", 3: "u"}
    after = {"s": 1, "u": 2, "a": 3}
    best = {0: (0, "", ())}

    def better(new, s, way):
        if s not in new or way[:2] < new[s][:2]:
            new[s] = way

    def insert(ways):
        for _ in range(3):
            for s, (cost, audit, out) in list(ways.items()):
                for x in follow[s].replace("s", ""):
                    better(ways, after[x], (cost + 5, audit + "I", (*out, ("user" if x == "u" else "assistant") + ":")))
        return ways

    for role, text, gone, cut in turns:
        new = {}
        for s, (cost, audit, out) in insert(dict(best)).items():
            better(new, s, (cost + 2, audit + "D", out))
            if not gone:
                extra = 5 if cut else 0
                if role[:1] and role[:1] in follow[s]:
                    better(new, after[role[0]], (cost + extra, audit + "K", (*out, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if name[0] in follow[s]:
                        better(new, after[name[0]], (cost + 1 + extra, audit + "R", (*out, f"{name}:{text}")))
        best = new
    ways = insert(dict(best))
    return min(ways[s] for s in (0, 3) if s in ways)


def plain_repair(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], [])
    for r in plain_damage(rows):
        convs[r[0]].append(r)
    out = {}
    for conv, rs in convs.items():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        seen, turns, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in rs:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            turns.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        nums = [r[1] for r in rs if r[1] is not None]
        gaps = max(nums) - min(nums) + 1 - len(set(nums)) if nums else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        cost, audit, text = plain_edits(turns)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest())
    return out


def repaired(spark, rows):
    got = repair.repair_damaged(spark.createDataFrame(rows, KIND)).collect()
    assert len(got) == len({r[0] for r in rows})
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got}


def some_rows(seed, n, turns):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "Ada"]
    texts = ["Yes.", "No!", "What", "", " \n", "Well? ", "a b c.", "é…", "ok\x0b"]
    return [(conv, t, rng.choices(roles, [9, 9, 3, 1, 1, 1])[0], rng.choices(texts, [9, 5, 4, 1, 1, 4, 4, 2, 1])[0] + rng.choice(["", "", str(rng.randrange(50)) + "."])) for conv in range(n) for t in range(rng.randrange(1, turns))]


def test_random_conversations_equal_brute_force(spark):
    rows = some_rows(1, 60, 9)
    assert repaired(spark, rows) == plain_repair(rows)


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_blocks_of_any_size_give_the_same(spark, bits, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", bits)
    rows = some_rows(2, 3, 40)
    assert repaired(spark, rows) == plain_repair(rows)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "Hi."), (None, None, "assistant", None), (1, None, None, "x."), (1, None, "user", "x."), (1, 5, "user", "x."), (1, 5, "user", "x."), (1, 5, "assistant", "x."), (2, 9, "user", "y" * 100_000), (2, -3, "assistant", "z.")]
    rows += [(3, t, "user", "same.") for t in range(0, 40, 2)] + [(4, None, "user", "many.")] * 30
    assert repaired(spark, rows) == plain_repair(rows)


def test_all_rows_lost_and_empty_table(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert repaired(spark, [(lost, 0, "user", "Hi.")]) == {lost: nothing}
    assert repair.repair_damaged(spark.createDataFrame([], KIND)).count() == 0


def test_costs_of_blocks_compose():
    rng = random.Random(3)
    for _ in range(50):
        a, b = ([rng.randrange(9) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        ma, mb, whole = repair.matrix(a), repair.matrix(b), repair.matrix(a + b)
        for s in range(4):
            for e in range(4):
                assert min(repair.NEVER, min(ma[4 * s + k] + mb[4 * k + e] for k in range(4))) == min(repair.NEVER, whole[4 * s + e])


def test_real_conversations(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in turns.select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_damaged(turns).collect()}
    assert got == plain_repair(rows)
