"""Structure repair of conversations: the cheapest edits that make the roles follow the grammar (s?(ua)+)?.

A dynamic program over turns and grammar states. Backward: what it costs to finish from each state
before each turn. Forward: a greedy walk that takes, among the edits on a cheapest way, the one whose
initial is ASCII-least. The repaired turns are rebuilt and hashed.

Edits: Keep costs 0, Rerole to user or assistant 1, Delete 2, Insert an empty user or assistant turn 5.
Blank turns, and turns whose role and text were there before, must go. A turn that stays though its
text ends in no [.!?] costs 5 more.

Long conversations are divided. Turns get places by a sort over ranges, and blocks of at most BLOCK
places are solved apart: a block's costs form a 4 x 4 matrix (state in, state out; minimum and sum), the
matrices of a conversation are folded from its end, and the exits that follow from the costs are folded
from its start. Only these folds, a few numbers a block, and the last pass, which streams a
conversation's texts through one hash, are in order. No step holds a conversation.

Defined results: a null conv_id is one conversation, named null. A null role, text or turn counts as
one space (in the damage's hash, too). Turns are in order of turn (nulls first), then role, then the
text's SHA-256. Repeated rows are duplicates. A role's initial is its first character, so roles that
begin with s, u or a pass as such. An empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora_spark.llm.common import lean, materialize, release

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: A block is a run of so many places (a power of two).
BLOCK = 12
#: States: at the start, after the system turn, after a user's, after an assistant's. What comes next: the state after it, and its initial.
NEXT = ((2, "u"), (2, "u"), (3, "a"), (2, "u"))
NAMES = {"u": "user", "a": "assistant"}
NEVER = 1 << 40
Costs = tuple[int, int, int, int]


def _inserted(v: Costs) -> Costs:
    """Costs where turns may be inserted first."""
    user, assistant = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + user), min(v[1], INSERT + user), user, assistant


#: Costs at the end.
END = _inserted((0, NEVER, NEVER, 0))
FORCED, INITIALS = 0, "sua"


def code_of(initial: Column, forced: Column, truncated: Column) -> Column:
    """A turn as a number: 0 if it must go; else twice its initial's number in `sua?`, and whether it is truncated, plus 1."""
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.when(forced, FORCED).otherwise(1 + 2 * kind + truncated.cast("int")).cast("int")


def _ways(code: int, state: int, after: Costs) -> list[tuple[str, int, int]]:
    """(edit, cost to the end, state) of a turn in a state; edits: D, K, or U and A for a new role. In the order of their initials."""
    out = [("D", DELETE + after[state], state)]
    if code != FORCED:
        kind, cut = divmod(code - 1, 2)
        extra = TRUNCATED * cut
        if kind == 0 and state == 0:
            out.append(("K", KEEP + extra + after[1], 1))
        to, initial = NEXT[state]
        if kind == (1 if initial == "u" else 2):
            out.append(("K", KEEP + extra + after[to], to))
        out.append((initial.upper(), REROLE + extra + after[to], to))
    return out


@cache
def _step(code: int, after: Costs) -> tuple[Costs, int]:
    """Costs before a turn, less the smallest, and the smallest. after: likewise less the smallest, so there are few of them."""
    v = _inserted(tuple(min(NEVER, min(cost for _, cost, _ in _ways(code, state, after))) for state in range(4)))
    low = min(v)
    return tuple(min(NEVER, x - low) if x < NEVER // 2 else NEVER for x in v), low


@cache
def _choice(code: int, after: Costs, state: int) -> tuple[str, int]:
    """The edits at a turn, insertions (u, a) before it included, and the state after it."""
    done = ""
    before = _inserted(tuple(min(cost for _, cost, _ in _ways(code, s, after)) for s in range(4)))
    while True:
        ways = _ways(code, state, after)
        to, initial = NEXT[state]
        ways.insert(1, (initial, INSERT + before[to], to))  # I comes after D and before K
        edit, _, state = next(w for w in ways if w[1] == before[state])
        done += edit
        if edit not in NAMES:
            return done, state


def _less(v: Costs) -> tuple[Costs, int]:
    low = min(v)
    return tuple(NEVER if x >= NEVER // 2 else x - low for x in v), low


def matrix(codes: list[int]) -> list[int]:
    """Costs from each state before a block (rows) to each state after it, one after another."""
    columns = []
    for end in range(4):
        v, total = tuple(0 if s == end else NEVER for s in range(4)), 0
        for code in reversed(codes):
            v, low = _step(code, v)
            total += low
        columns.append([x if x >= NEVER else x + total for x in v])
    return [columns[end][start] for start in range(4) for end in range(4)]


def edits(codes: list[int], after: Costs, state: int) -> tuple[list[str], int]:
    """The edits at each turn of a block, entered in a state, and the state after it."""
    laters = []
    v, _ = _less(after)
    for code in reversed(codes):
        laters.append(v)
        v, _ = _step(code, v)
    out = []
    for code, later in zip(codes, reversed(laters)):
        edit, state = _choice(code, later, state)
        out.append(edit)
    return out, state


def trailing(state: int) -> str:
    """What is inserted at the end."""
    return {1: "ua", 2: "a"}.get(state, "")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of conversations after a damage that the checksum of `conv_id:turn` chooses; column n: 2 for a row that is repeated."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))), F.lit(20))
    role, text = F.when(F.col("d") == 4, "user").otherwise(F.col("role")), F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), d.alias("d"))
    return rows.where("d <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("d") == 3, 2).otherwise(1).alias("n"))


def _coded(rows: DataFrame) -> DataFrame:
    """Rows without their texts, equal ones as one: (none, conv, turn, role, sha, code, n, blank, later, truncated)."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    slim = rows.select("none", "conv", "turn", "role", "sha", "n", (last == "").alias("blank"), ((last != "") & ~last.isin(".", "!", "?")).alias("truncated"))
    same = slim.groupBy("none", "conv", "turn", "role", "sha").agg(F.sum("n").alias("n"), F.first("blank").alias("blank"), F.first("truncated").alias("truncated"))
    same = materialize(same, "turns")
    first = same.groupBy("none", "conv", "role", "sha").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    later = F.struct(F.col("turn").isNotNull(), F.col("turn")) > F.col("first")
    both = same.join(first, ["none", "conv", "role", "sha"]).withColumn("later", later).drop("first")
    return both.withColumn("code", code_of(F.left("role", F.lit(1)), F.col("blank") | F.col("later"), F.col("truncated")))


def _fold(blocks: DataFrame, backward: bool) -> DataFrame:
    """(none, conv, block, after array) from their matrices, or (none, conv, block, entry) from their exits; a conversation's blocks come in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for batch in batches:
            out = []
            for none, conv, _, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (none, conv) != key:
                    key, now = (none, conv), list(END) if backward else 0
                out.append(now)
                now = [min(NEVER, min(data[4 * s + e] + now[e] for e in range(4))) for s in range(4)] if backward else data[now]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(out, pa.list_(pa.int64()) if backward else pa.int32())], names=["none", "conv", "block", "after" if backward else "entry"])

    rows = blocks.repartition("none", "conv").sortWithinPartitions("none", "conv", F.desc("block") if backward else "block")
    return rows.mapInArrow(lean(run), "none boolean, conv long, block long, " + ("after array<bigint>" if backward else "entry int"))


def _by_block(blocks: DataFrame, work, result: str, kind: pa.DataType) -> DataFrame:
    """(none, conv, block, work(codes and what follows them)) of rows (none, conv, block, codes, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [work(*x) for x in zip(*(c.to_pylist() for c in batch.columns[3:]))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(out, kind)], names=["none", "conv", "block", "out"])

    return blocks.mapInArrow(lean(run), f"none boolean, conv long, block long, out {result}")


def planned(rows: DataFrame) -> DataFrame:
    """(none, conv, turn, role, sha, n, blank, later, truncated, edit) of the different rows: what is done at each.

    Of n equal rows the first one has the edit, the others are deleted.
    """
    coded = materialize(_coded(rows), "coded")
    placed = coded.repartitionByRange("none", "conv", "turn", "role", "sha").sortWithinPartitions("none", "conv", "turn", "role", "sha")
    placed = materialize(placed.withColumn("place", F.monotonically_increasing_id()), "placed")
    release(coded)
    key = ["none", "conv", "block"]
    listed = placed.groupBy("none", "conv", F.shiftright("place", BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "code"))).alias("rows"))  # at most 2 ** BLOCK rows
    blocks = materialize(listed.select(*key, F.col("rows.code").alias("codes"), F.col("rows.place").alias("places")), "blocks")
    # Only conversations of several blocks need the folds.
    several = blocks.groupBy("none", "conv").agg(F.count("*").alias("k")).where("k > 1").select("none", "conv")
    parts = materialize(blocks.join(several, ["none", "conv"], "left_semi").select(*key, "codes"), "parts")
    folded = materialize(_fold(_by_block(parts, matrix, "array<bigint>", pa.list_(pa.int64())), True), "after")
    exits = _by_block(parts.join(folded, key), lambda codes, after: [edits(codes, tuple(after), s)[1] for s in range(4)], "array<int>", pa.list_(pa.int32()))
    entries = materialize(_fold(exits, False), "entry")
    whole = blocks.join(folded, key, "left").join(entries, key, "left")
    whole = whole.select(*key, "codes", F.coalesce("after", F.lit(list(END)).cast("array<bigint>")).alias("after"), F.coalesce("entry", F.lit(0)).alias("entry"), "places")
    done = _by_block(whole, lambda codes, after, entry, places: [{"place": p, "edit": e} for p, e in zip(places, edits(codes, tuple(after), entry)[0])], "array<struct<place: bigint, edit: string>>", pa.list_(pa.struct([("place", pa.int64()), ("edit", pa.string())])))
    found = done.select(F.explode("out").alias("x")).select("x.place", "x.edit")
    return placed.join(found, "place").drop("place", "code")


REPORT = "none boolean, conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Report:
    """What is told of a conversation, gathered while its turns pass in order."""

    def __init__(self) -> None:
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.before, self.state, self.audit, self.sha, self.begun, self.open = None, 0, [], hashlib.sha256(), False, False

    def say(self, role: str) -> None:
        self.sha.update((("\n" if self.begun else "") + role + ":").encode("utf-8", "surrogatepass"))
        self.begun, self.state = True, {"s": 1, "u": 2, "a": 3}[role[0]]

    def insert(self, initials: str) -> None:
        for x in initials:
            self.cost += INSERT
            self.audit.append("I")
            self.say(NAMES[x])

    def turn(self, turn: int | None, role: str, n: int, blank: bool, later: bool, truncated: bool, edit: str) -> None:
        if turn is not None and (self.last is None or turn != self.last):
            self.low, self.high, self.last, self.turns = turn if self.low is None else self.low, turn, turn, self.turns + 1
        self.blank += n * blank
        self.duplicate += 0 if blank else n - (not later)
        self.truncated += truncated and not blank and not later
        pair = (self.before or "") + role[:1]
        self.illegal += self.before is not None and pair not in ("su", "ua", "au")
        self.illegal += n - 1  # equal roles beside each other
        self.before = role[:1]
        self.insert(edit[:-1])
        self.open = edit[-1] != "D"
        if self.open:
            self.cost += (REROLE if edit[-1] != "K" else KEEP) + TRUNCATED * truncated
            self.audit.append("K" if edit[-1] == "K" else "R")
            self.say(role if edit[-1] == "K" else NAMES[edit[-1].lower()])
        else:
            self.cost += DELETE
            self.audit.append("D")
        self.cost += DELETE * (n - 1)
        self.audit.append("D" * (n - 1))

    def text(self, data: bytes) -> None:
        if self.open:
            self.sha.update(data)
            self.open = False

    def row(self) -> tuple:
        self.insert(trailing(self.state))
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def repair(turns: DataFrame) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, text, n) without nulls in role and text: faults, cost, edits and the hash of the repaired turns."""
    rows = turns.select(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("conv"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("sha"), "n", "text")
    plan = planned(rows)
    empty = F.lit(None)
    first = plan.select("none", "conv", "turn", "role", "sha", F.lit(0).alias("kind"), "n", "blank", "later", "truncated", "edit", empty.cast("binary").alias("text"))
    then = rows.select("none", "conv", "turn", "role", "sha", F.lit(1).alias("kind"), F.col("n").cast("long").alias("n"), *(empty.cast("boolean").alias(c) for c in ("blank", "later", "truncated")), empty.cast("string").alias("edit"), F.col("text").cast("binary").alias("text"))
    # Each different row's edit comes before its text; a conversation passes in one stream.
    stream = first.unionByName(then).repartition("none", "conv").sortWithinPartitions("none", "conv", "turn", "role", "sha", "kind").drop("sha")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in REPORT.split(", ")]
        kinds = [pa.bool_(), *[pa.int64()] * 7, pa.string(), pa.string()]
        key, report, out = None, None, []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)
        for batch in batches:
            for none, conv, turn, role, kind, n, blank, later, truncated, edit, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (none, conv) != key:
                    if report:
                        out.append((*key, *report.row()))
                    key, report = (none, conv), _Report()
                if kind:
                    report.text(text)
                else:
                    report.turn(turn, role, n, blank, later, truncated, edit)
            if len(out) > 5_000:
                yield pack()
                out = []
        if report:
            out.append((*key, *report.row()))
        if out:
            yield pack()

    found = stream.mapInArrow(lean(run), REPORT)
    return found.withColumn("conv_id", F.when(~F.col("none"), F.col("conv"))).drop("none", "conv")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """repair() of damaged() conversations; those that lost all rows have zeros, no edits and the hash of nothing."""
    found = repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    none = hashlib.sha256().hexdigest()
    out = every.join(found.withColumnRenamed("conv_id", "id"), F.col("conv_id").eqNullSafe(F.col("id")), "left")
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
