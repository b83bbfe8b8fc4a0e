"""Byte-level BPE encoding and decoding, without regular expressions.

Pre-tokenisation works on arrays: each code point gets a class, and each class is a transition
function on the few states that a token boundary depends on. Functions compose associatively, so a
long text is cut into equal lanes: one pass finds each lane's function, their composition gives
each lane's first state, and a second pass marks the boundaries in all lanes at once. The slices
between boundaries feed a cache of merged pieces; token ids are gathered from its table. Pieces that
are new are merged all at once, each step taking every piece's pair of the lowest rank.

Ids are kept packed, as little-endian unsigned 32-bit integers in a binary column, the usual form of
training shards. Decoding needs only the ids: offsets into one buffer of all tokens' bytes give the
text back. With offsets=True the end of each token in the text's UTF-8 bytes is kept too.

Defined results: null and empty texts have no tokens; ids of rows may be null or repeated and are
passed through. Empty tables give empty tables. Very long texts and very long pieces are encoded
whole (long pieces merge by a heap). Control strings in texts are ordinary text. Only the named
columns are read; others can have any name.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora_spark.llm.common import lean

#: Symbols: a document's end; ' ', other white space, letters, numbers, the rest; an apostrophe that one or two letters make a contraction.
STOP, SPACE, BLANK, LETTER, NUMBER, OTHER, SHORT, LONG = range(8)
#: States, by what came last: nothing of this token, then as above; one or two letters of a contraction to come.
FRESH, ONE, TWO = STOP, SHORT, LONG
#: Code points with the White_Space property.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LANE = 256


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol * 8 + state], and whether a token starts there (white space is handled by its neighbours)."""
    after, starts = np.zeros((8, 8), np.uint8), np.zeros((8, 8), bool)
    for state in range(8):
        after[STOP, state], starts[STOP, state] = FRESH, True
        after[SPACE, state], after[BLANK, state] = SPACE, BLANK
        for symbol in (LETTER, NUMBER, OTHER, SHORT, LONG):
            kind = OTHER if symbol in (SHORT, LONG) else symbol
            if state in (ONE, TWO):  # only letters come here
                after[symbol, state] = FRESH if state == ONE else ONE
            elif state == SPACE or (state == OTHER and kind == OTHER):  # it joins what stands before
                after[symbol, state] = kind
            else:
                starts[symbol, state] = state != kind
                after[symbol, state] = symbol
    return after.ravel(), starts.ravel()


NEXT, STARTS = _automaton()


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for k in range(0x110000):
        first = unicodedata.category(chr(k))[0]
        if first in "LN":
            table[k] = LETTER if first == "L" else NUMBER
    table[WHITE] = BLANK
    table[0x20] = SPACE
    return table


def symbols(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """The symbol of each code point; stops: where documents end."""
    out = classes()[points]
    out[stops] = STOP
    marks = np.flatnonzero(points == 0x27)
    if len(marks):
        padded = np.concatenate((points, np.zeros(2, points.dtype)))
        one, two = padded[marks + 1], padded[marks + 2]
        is_ = lambda c: one == ord(c)
        short = is_("s") | is_("t") | is_("m") | is_("d")
        long = (is_("r") | is_("v")) & (two == ord("e")) | is_("l") & (two == ord("l"))
        out[marks[short]] = SHORT
        out[marks[long]] = LONG
        out[stops] = STOP
    return out


def boundaries(symbol: np.ndarray) -> np.ndarray:
    """Boolean: where a token starts. The last symbol must be STOP; each STOP counts as a start."""
    n = len(symbol)
    lanes = -(-n // LANE)
    padded = np.zeros(lanes * LANE, np.uint8)
    padded[:n] = symbol
    steps = np.ascontiguousarray(padded.reshape(lanes, LANE).T.astype(np.intp) * 8)
    state = np.zeros(lanes, np.uint8)
    for step in steps:
        state = NEXT[step + state]
    # A lane with a stop or white space ends in the same state whatever came before; others are whole functions.
    function = np.repeat(state[:, None], 8, axis=1)
    free = np.flatnonzero((steps > BLANK * 8).all(axis=0))
    if len(free):
        part = np.repeat(np.arange(8, dtype=np.uint8)[None, :], len(free), axis=0)
        for step in steps[:, free]:
            part = NEXT[step[:, None] + part]
        function[free] = part
    first, now = np.empty(lanes, np.uint8), FRESH
    for k, f in enumerate(function.tolist()):  # the functions' composition
        first[k], now = now, f[now]
    found, state = np.empty((LANE, lanes), bool), first
    for k, step in enumerate(steps):
        at = step + state
        found[k] = STARTS[at]
        state = NEXT[at]
    start = found.T.ravel()[:n].copy()
    white = (symbol == SPACE) | (symbol == BLANK)
    before = np.concatenate(([False], white[:-1]))
    follows = np.concatenate((~white[1:] & (symbol[1:] != STOP), [False]))
    start[white] = (~before | follows)[white]  # of a run of white space the last stands apart, unless the text ends
    return start


#: More than any rank.
NONE = 1 << 31


class Pairs:
    """The token that two neighbouring tokens make, looked up for many pairs at once in a table with open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        left, right, made = np.array(found, np.int64).reshape(-1, 3).T
        self.bits = max(4, (3 * len(left)).bit_length())
        self.keys, self.made = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        key = left << 32 | right
        at, todo = self._start(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            won = free[np.unique(at[free], return_index=True)[1]]  # of several that want one place, one gets it
            self.keys[at[won]], self.made[at[won]] = key[won], made[won]
            todo = todo[self.keys[at[todo]] != key[todo]]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)

    def _start(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The tokens, NONE where there is none."""
        key = left << 32 | right
        at = self._start(key)
        odd = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(odd):
            at[odd] = (at[odd] + 1) & (len(self.keys) - 1)
            there = self.keys[at[odd]]
            odd = odd[(there != key[odd]) & (there >= 0)]
        return np.where(self.keys[at] == key, self.made[at], NONE)


class Vocabulary:
    """Token ids by bytes, and the bytes by id in one buffer with offsets."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, k in self.ranks.items():
            tokens[k] = token
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = Pairs(self.ranks)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All tokens' bytes after one another, and where each ends."""
        size = self.size[ids]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - ends + size, size)
        return self.bytes[place], ends

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces after one another, and how many each has: the pair of the lowest rank is merged, the leftmost first, until none is in the vocabulary."""
        whole = [self.ranks.get(p) for p in pieces]
        long = [k for k, (p, r) in enumerate(zip(pieces, whole)) if r is None and len(p) > 100]
        few = [k for k, (p, r) in enumerate(zip(pieces, whole)) if r is None and 0 < len(p) <= 100]
        known = [k for k, r in enumerate(whole) if r is not None]
        made = [(np.array(known, np.int64), np.array([whole[k] for k in known], np.int64))]
        for k in long:
            ids = np.array(self._merge_long(pieces[k]), np.int64)
            made.append((np.full(len(ids), k), ids))
        if few:
            owner, ids = self._merge_at_once([pieces[k] for k in few])
            made.append((np.array(few, np.int64)[owner], ids))
        owner, ids = (np.concatenate(x) for x in zip(*made))
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(pieces))

    def _merge_at_once(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(owner, id) of each token of the pieces, a piece's tokens in order."""
        token = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        rank = np.full(len(token), NONE, np.int64)  # of a token with the one behind it
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self.pairs.look(token[inner], token[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(token):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            low = np.minimum.reduceat(rank << 31 | np.arange(len(token)), first)  # the lowest rank, then the leftmost
            live = low < NONE << 31
            goes = ~np.repeat(live, np.diff(np.concatenate((first, [len(token)]))))
            done.append((owner[goes], token[goes]))
            at, made = low[live] & (NONE - 1), low[live] >> 31
            token[at] = made
            goes[at + 1] = True  # it is part of the new token
            at -= np.cumsum(goes)[at]
            token, owner, rank = token[~goes], owner[~goes], rank[~goes]
            rank[at] = NONE
            for place in (at, at - 1):  # the new token with the one behind it, and the one before with it
                place = place[(place >= 0) & (place + 1 < len(token))]
                place = place[owner[place] == owner[place + 1]]
                rank[place] = self.pairs.look(token[place], token[place + 1])
        owner, token = (np.concatenate(x) for x in zip(*done))
        return owner, token

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same by a heap of pairs and a linked list of parts."""
        n, get = len(piece), self.ranks.get
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))  # by a part's first byte
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := get(piece[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            gone = end[i]
            alive[gone], end[i] = False, stop
            if stop < n:
                prev[stop] = i
            offer(prev[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out


class Encoder:
    """Encodes batches of texts; keeps up to `keep` merged pieces, forgetting all when it is full."""

    def __init__(self, path: str, keep: int = 150_000):
        self.vocabulary, self.keep = Vocabulary(path), keep
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.size, self.used = np.empty(1 << 20, np.uint32), np.empty(1 << 18, np.int64), 0

    def _learn(self, pieces: set[str]) -> None:
        base = len(self.index)
        pieces = list(pieces)
        new, size = self.vocabulary.merge_all([p.encode("utf-8", "surrogatepass") for p in pieces])
        self.index.update(zip(pieces, range(base, base + len(pieces))))
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while base + len(size) > len(self.size):
            self.size = np.concatenate((self.size, np.empty_like(self.size)))
        self.ids[self.used : self.used + len(new)] = new
        self.size[base : base + len(size)] = size
        self.used += len(new)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after one another, and how many each text has."""
        joined = "\n".join(texts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        stops = np.cumsum([len(t) + 1 for t in texts]) - 1
        symbol = symbols(points, stops)
        start = np.flatnonzero(boundaries(symbol))
        real = symbol[start[:-1]] != STOP
        first, last = start[:-1][real], start[1:][real]
        pieces = [joined[a:b] for a, b in zip(first.tolist(), last.tolist())]
        if len(self.index) > self.keep:
            self._clear()
        unknown = set(pieces).difference(self.index)
        if unknown:
            self._learn(unknown)
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        known = len(self.index)
        offset = np.cumsum(self.size[:known]) - self.size[:known]
        size = self.size[at]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offset[at] - ends + size, size)
        through = np.concatenate(([0], ends))[np.searchsorted(first, stops)]
        return self.ids[place], np.diff(np.concatenate(([0], through)))


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _groups(texts: list[str], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` characters; a longer text stands alone."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, k
            at, size = k, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def encode_texts(df: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decoded: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """(id, columns of keep, n_tokens long, ids binary[, ends binary][, decoded binary]) of each row; ranks: path of the rank file on each machine.

    decoded: the bytes that the ids decode to, made in the same task.
    """
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks)
        for batch in (whole.slice(a, 1_000) for whole in batches for a in range(0, len(whole), 1_000)):
            texts = [t or "" for t in batch.column(len(names)).to_pylist()]
            for a, b in _groups(texts):
                ids, count = enc.encode(texts[a:b])
                packed = _binary(ids.astype("<u4").view(np.uint8), count * 4)
                out = [*(batch.column(k).slice(a, b - a) for k in range(len(names))), pa.array(count, pa.int64()), packed]
                if offsets:
                    size = enc.vocabulary.size[ids]
                    ends, through = np.cumsum(size), np.cumsum(count)
                    before = np.concatenate(([0], ends))[through - count]
                    out.append(_binary((ends - np.repeat(before, count)).astype("<u4").view(np.uint8), count * 4))
                if decoded:
                    data, ends = enc.vocabulary.decode(ids)
                    through = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(count)))]
                    out.append(_binary(data, np.diff(through)))
                yield pa.RecordBatch.from_arrays(out, names=[*names, "n_tokens", "ids", *["ends"] * offsets, *["decoded"] * decoded])

    rows = df.select(*(F.col(c) for c in names), F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip(names, rows.schema))
    return rows.mapInArrow(lean(run), f"{kinds}, n_tokens long, ids binary" + ", ends binary" * offsets + ", decoded binary" * decoded)


def _binary(data: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def decode_ids(df: DataFrame, ranks: str, keep: Sequence[str] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """The columns of keep, and decoded binary: the bytes of each row's packed ids (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(ranks).vocabulary
        for batch in batches:
            column = batch.column(len(keep)).fill_null(b"")
            size = np.array([len(x) for x in column.to_pylist()], np.int64) // 4
            step = np.searchsorted(np.cumsum(size), np.arange(0, size.sum() + 1, 1 << 18)[1:])
            for a, b in zip([0, *step + 1], [*step + 1, len(size)]):
                if a < b:
                    ids = np.frombuffer(b"".join(column.slice(a, b - a).to_pylist()), "<u4")
                    data, ends = vocabulary.decode(ids)
                    through = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(size[a:b])))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(keep))), _binary(data, np.diff(through))], names=[*keep, "decoded"])

    rows = df.select(*(F.col(c) for c in keep), F.col(ids_col))
    kinds = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip(keep, rows.schema))
    return rows.mapInArrow(lean(run), f"{kinds}, decoded binary")
