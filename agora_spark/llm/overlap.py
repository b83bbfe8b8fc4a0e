"""Blocks of sets that share a key, and the links among them.

Shared by the n-gram join and the line dedup. A node is a set with a 63-bit digest. Nodes that share a
key (a part, a band) make a group. Keys travel packed: each task sorts its entries by bucket and sends
one binary per bucket, and a bucket's task sorts them by key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora_spark.llm.common import lean, materialize, release
from agora_spark.llm.components import connected

Decode = Callable[[pa.Array], list[np.ndarray]]
#: A key's hash, a node, and how many of the node's keys of this kind need not meet. The hash's last bit tells two kinds of keys apart.
ENTRY = np.dtype([("sign", "<u4"), ("node", "<u8"), ("spare", "<u2")])


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def digest(data: bytes) -> int:
    """A node: 63 bits of a hash."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little") >> 1


def deal(signs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], buckets: int, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """(bucket, entries) batches of (keys, nodes, spares) arrays; holds at most about `most` entries."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        sign, node, spare = (np.concatenate([h[k] for h in held]) for k in range(3))
        bucket = (sign % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        packed = np.empty(len(order), ENTRY)
        packed["sign"], packed["node"], packed["spare"] = (sign[order] >> np.uint64(32)).astype(np.uint32), node[order], np.minimum(spare[order], 65535)
        which, first = np.unique(bucket[order], return_index=True)
        return pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array([x.tobytes() for x in np.split(packed, first[1:])], pa.binary())], names=["bucket", "entries"])

    for entry in signs:
        held.append(entry)
        size += len(entry[0])
        if size > most:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def groups(dealt: DataFrame) -> DataFrame:
    """(gid, u, p): the nodes u of each group of at least two, and its pivot p; groups with the same nodes are one.

    A node leaves its largest groups, as many keys as it has to spare. If nodes that link share all but
    d of their keys, and each keeps its d + 1 rarest, they still meet: the rarest key that they share is
    among those of both. So a key that very many nodes share groups only those that have little else.
    """

    def meet(table: pa.Table) -> pa.Table:
        e = np.frombuffer(b"".join(table.column("entries").to_pylist()), ENTRY)
        e = e[np.lexsort((e["node"], e["sign"]))]
        sign, node = e["sign"], e["node"]
        e = e[np.concatenate(([True], (sign[1:] != sign[:-1]) | (node[1:] != node[:-1])))]
        sign, node, spare = e["sign"], np.ascontiguousarray(e["node"]), np.ascontiguousarray(e["spare"])
        first = np.flatnonzero(np.concatenate(([True], sign[1:] != sign[:-1])))
        count = np.diff(np.concatenate((first, [len(sign)])))
        found: dict[bytes, list] = {}
        for a, n in zip(first[count > 1].tolist(), count[count > 1].tolist()):
            held = node[a : a + n].tobytes()
            if spare[a : a + n].any():
                held += b"1" if sign[a] & 1 else b"0"
            found.setdefault(held, [a, a + n, 0])[2] += 1
        members = [node[a:b].astype(np.int64) for a, b, _ in found.values()]
        spares = [spare[a:b].astype(np.int32) for a, b, _ in found.values()]
        ends = pa.array(np.concatenate(([0], np.cumsum([len(m) for m in members]))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.zeros(0, kind))) for x, kind in ((members, np.int64), (spares, np.int32))]
        gid = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in found]
        kinds = [len(x) % 8 and x[-1] & 1 for x in found]
        return pa.table([pa.array(gid, pa.int64()), pa.array([k for _, _, k in found.values()], pa.int64()), pa.array(kinds, pa.int32()), *lists], names=["gid", "keys", "kind", "members", "spares"])

    found = dealt.groupBy("bucket").applyInArrow(meet, "gid long, keys long, kind int, members array<long>, spares array<int>")
    found = materialize(found.groupBy("gid").agg(F.sum("keys").alias("keys"), *(F.first(c).alias(c) for c in ("kind", "members", "spares"))), "groups")
    rows = found.select("gid", "keys", "kind", F.size("members").alias("n"), F.explode(F.arrays_zip("members", "spares")).alias("m")).select("gid", "keys", "kind", "n", F.col("m.members").alias("u"), F.col("m.spares").alias("spare"))
    largest = Window.partitionBy("u", "kind").orderBy(F.desc("n"), "gid").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("weight", F.sum("keys").over(Window.partitionBy("u"))).withColumn("so_far", F.sum("keys").over(largest))
    kept = materialize(rows.where("so_far > spare").select("gid", "u", "weight"), "members")
    # The pivot is the row that shares most keys with others: of near copies, that with the fewest changes.
    pivots = kept.groupBy("gid").agg(F.max(F.struct("weight", (-F.col("u")).alias("minus"))).alias("m"), F.count("*").alias("n")).where("n > 1").select("gid", (-F.col("m.minus")).alias("p"))
    out = materialize(kept.join(pivots, "gid").select("gid", "u", "p"), "members")
    release(found, kept)
    return out


def _blocks(pairs: DataFrame, pivots: DataFrame, sets: DataFrame, per_task: int = 2_000) -> DataFrame:
    """(p, kind, u, c, cp, data) of pairs (u, p, c, cp), in streams of a pivot's data (kind 0) and then its rows' (kind 1). pivots: (p, data); sets: (node, data).

    A pivot of many rows has many streams; cp of kind 0 is their number.
    """
    shares = pairs.groupBy("p").agg(F.ceil(F.count("*") / per_task).cast("int").alias("shares"))
    rows = pairs.join(shares, "p").withColumn("share", F.pmod(F.xxhash64("u"), F.col("shares")).cast("int"))
    right = rows.join(sets.withColumnRenamed("node", "u"), "u").select("p", "share", F.lit(1).alias("kind"), "u", "c", "cp", "data")
    left = shares.join(pivots, "p").select("p", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), F.col("p").alias("u"), F.col("p").alias("c"), F.col("shares").cast("long").alias("cp"), "data")
    return left.unionByName(right).repartition("p", "share").sortWithinPartitions("p", "share", "kind").select("p", "kind", "u", "c", "cp", "data")


@dataclass
class Run:
    """Some rows of a stream of _blocks(), one of so many of the pivot; first: the stream begins with it."""

    p: int
    pivot: np.ndarray
    streams: int
    first: bool
    u: np.ndarray
    c: np.ndarray
    cp: np.ndarray
    rows: list[np.ndarray]


def _runs(batches: Iterator[pa.RecordBatch], decode: Decode, pivot_decode: Decode) -> Iterator[Run]:
    pivot, streams, first = None, 1, False
    for batch in (whole.slice(k, 256) for whole in batches for k in range(0, len(whole), 256)):
        p, kind = (batch.column(k).to_pylist() for k in range(2))
        u, c, cp = (batch.column(k).to_numpy() for k in (2, 3, 4))
        data, at = batch.column(5), 0
        sets: dict[int, np.ndarray] = {}
        for places, read in ((np.flatnonzero(np.array(kind)), decode), (np.flatnonzero(np.array(kind) == 0), pivot_decode)):
            sets.update(zip(places.tolist(), read(data.take(pa.array(places))) if len(places) else ()))
        while at < len(p):
            if kind[at] == 0:
                pivot, streams, first = sets[at], int(cp[at]), True
                at += 1
                continue
            end = at
            while end < len(p) and kind[end] == 1 and p[end] == p[at]:
                end += 1
            yield Run(p[at], pivot, streams, first, u[at:end], c[at:end], cp[at:end], [sets[k] for k in range(at, end)])
            at, first = end, False


def link(pairs: DataFrame, sets: DataFrame, decode: Decode, percent: int) -> DataFrame:
    """(a, b): the components c and cp of those pairs (u, p, c, cp) that link. sets: (node, data); decode makes sorted arrays of grams from data.

    The pivot p and its rows u form blocks; a block's rows pass in one stream, and each run of rows is
    multiplied with the pivot at once.
    """

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=["a", "b"])
        for run in _runs(batches, decode, decode):
            size = np.array([len(r) for r in run.rows])
            every = np.concatenate(run.rows)
            place = np.minimum(np.searchsorted(run.pivot, every), len(run.pivot) - 1)
            overlap = np.bincount(np.repeat(np.arange(len(size)), size), run.pivot[place] == every, len(size)).astype(np.int64)
            links = 100 * overlap >= percent * (size + len(run.pivot) - overlap)
            held.append((run.c[links], run.cp[links]))
            many += len(size)
            if many > 10_000:
                yield pack()
                held, many = [], 0
        if held:
            yield pack()

    return _blocks(pairs, sets.withColumnRenamed("node", "p"), sets).mapInArrow(lean(multiply), "a long, b long")


def common(stars: DataFrame, sets: DataFrame, decode: Decode, most: int = 31) -> DataFrame:
    """(p, data): a star's middle, the grams that at least half of up to `most` of its rows have. Any set would give right results; a near one saves work."""
    some = stars.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy(F.xxhash64("u"), "u"))).where(F.col("r") <= most)

    def vote(group: pa.Table) -> pa.Table:
        rows = decode(group.column("data").combine_chunks())
        gram, n = np.unique(np.concatenate(rows), return_counts=True)
        return pa.table([group.column("p").slice(0, 1), pa.array([gram[2 * n >= len(rows)].tobytes()], pa.binary())], names=["p", "data"])

    return some.join(sets.withColumnRenamed("node", "u"), "u").select("p", "data").groupBy("p").applyInArrow(vote, "p long, data binary")


#: A row of a star: its component, slack and size, and its odd sketch. A gram by which it differs from the star's middle: a hash of star and gram, the row's place, how many such grams follow in the star's order, and what pairs it is for.
ROW = np.dtype([("node", "<i8"), ("c", "<i8"), ("slack", "<i8"), ("size", "<i4"), ("sketch", "<u8", (8,))])
GRAM = np.dtype([("key", "<u8"), ("row", "<u4"), ("behind", "<i4"), ("role", "u1")])
NEAR, FAR, FARTHER, CLOSER, HUB = range(5)


def _sketch(grams: np.ndarray) -> np.ndarray:
    """512 bits: the parity of the grams that fall on each. Sketches of two sets differ in at most as many bits as the sets in grams."""
    odd = np.bincount((grams >> np.uint64(11)) & np.uint64(511), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


class _Packer:
    """Gathers rows and their grams by bucket; a star's grams are dealt over as many buckets as it has streams."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.clear()

    def clear(self) -> None:
        self.rows, self.grams, self.at, self.count, self.size = [], [], [], 0, 0

    def add(self, rows: np.ndarray, grams: np.ndarray, salt: np.ndarray, streams: int) -> None:
        """grams' rows are places in rows."""
        if len(grams):
            grams["row"] += self.count
            self.count += len(rows)
            self.rows.append(rows)
            self.grams.append(grams)
            self.at.append((_mix(salt + grams["key"] % np.uint64(streams)) % np.uint64(self.buckets)).astype(np.int64))
            self.size += len(grams)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            rows, grams, at = np.concatenate(self.rows), np.concatenate(self.grams), np.concatenate(self.at)
            order = np.argsort(at, kind="stable")
            which, first = np.unique(at[order], return_index=True)
            out = [], []
            for part in np.split(grams[order], first[1:]):
                used, part["row"] = np.unique(part["row"], return_inverse=True)
                out[0].append(rows[used].tobytes())
                out[1].append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), *(pa.array(x, pa.binary()) for x in out)], names=["bucket", "rows", "grams"])
        self.clear()


def differences(stars: DataFrame, sets: DataFrame, decode: Decode, percent: int, buckets: int) -> DataFrame:
    """(bucket, rows, grams): the grams by which the rows of stars (u, p, c, cp) differ from their star's middle, as far as candidates() needs them.

    Let s be a row's number of such grams and a = (100 - percent) * n - (100 + percent) * s its slack,
    which is at most (100 - percent) * the middle's size. Two rows differ in s + s' - 2 * (those that
    they share) grams, so they link iff they share at least -(a + a') / (2 * (100 + percent)) of them.
    If a + a' >= 0, both link with the star's hub, the row of most slack. Other pairs have a far row,
    one with a < 0. The bounds on slack tell how many grams any partner must share with a row at least;
    of the row's grams all but so many, less one, are sent, and the first gram that two partners share
    in the star's order is among those of both. Grams that the middle lacks come first, being rarer.
    Of two far rows the closer one, with more slack, sends fewer.
    """
    scale = 2 * (100 + percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(buckets)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def hubs(salt: np.ndarray) -> None:
            """The stream's row of most slack, and those of other components that may link with a hub for certain."""
            rows, top = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            best = np.lexsort((rows["node"], -rows["slack"]))[:1]
            rows = rows[np.concatenate((best, np.flatnonzero((rows["c"] != rows["c"][best]) & (rows["slack"] + top >= 0))))]
            grams = np.zeros(len(rows), GRAM)
            grams["key"], grams["row"], grams["role"] = salt, np.arange(len(rows)), HUB
            packer.add(rows, grams, salt, 1)
            held.clear()

        salt = None
        for part in _runs(batches, decode, lambda data: [np.frombuffer(x.as_py(), np.uint64) for x in data]):
            if part.first and held:
                hubs(salt)
            top, salt = (100 - percent) * len(part.pivot), _mix(np.array([part.p], np.int64).view(np.uint64))
            rows = np.zeros(len(part.rows), ROW)
            rows["node"], rows["c"], rows["size"] = part.u, part.c, [len(r) for r in part.rows]
            grams = []
            for k, row in enumerate(part.rows):
                other = np.setxor1d(row, part.pivot, assume_unique=True)
                inside = np.isin(other, part.pivot, assume_unique=True)
                s, slack = len(other), (100 - percent) * len(row) - (100 + percent) * len(other)
                rows["slack"][k], rows["sketch"][k] = slack, _sketch(row)
                send = s - (max(1, -((slack + top) // scale)) if slack < 0 else 1) + 1
                if send > 0:
                    out, place = np.empty(send, GRAM), np.arange(send)
                    out["key"], out["row"], out["behind"], out["role"] = _mix(np.concatenate((other[~inside], other[inside]))[:send] + salt), k, s - place, NEAR
                    if slack < 0:  # what it must share with rows that are farther, and with rows that are closer
                        out["role"] = np.where(place <= s + 2 * slack // scale, CLOSER, np.where(place <= s + (slack - 1) // scale, FARTHER, FAR))
                    grams.append(out)
            held.append((rows, np.full(len(rows), top)))
            packer.add(rows, np.concatenate(grams) if grams else np.empty(0, GRAM), salt, part.streams)
            if packer.size > 300_000:
                yield from packer.flush()
        if held:
            hubs(salt)
        yield from packer.flush()

    return _blocks(stars, common(stars, sets, decode), sets).mapInArrow(lean(run), "bucket long, rows binary, grams binary")


def candidates(dealt: DataFrame, percent: int, block: int = 512) -> DataFrame:
    """(u, p, c, cp) of differences(): pairs of rows of different components that the bounds do not rule out.

    Rows that share a gram of the same star meet: far with near, and farther with closer. Discarded are
    pairs with too few grams left to share from here on, and those whose odd sketches differ in too many bits.
    """
    scale = 2 * (100 + percent)

    def meet(table: pa.Table) -> pa.Table:
        rows = [np.frombuffer(x, ROW) for x in table.column("rows").to_pylist()]
        grams = [np.frombuffer(x, GRAM) for x in table.column("grams").to_pylist()]
        before = np.repeat(np.cumsum([0, *map(len, rows[:-1])]), [len(g) for g in grams])
        rows, grams = np.concatenate(rows), np.concatenate(grams)
        order = np.argsort(grams["key"], kind="stable")
        key, row, behind, role = grams["key"][order], (grams["row"] + before)[order], grams["behind"][order].astype(np.int64), grams["role"][order]
        node, c, slack, size, sketch = (np.ascontiguousarray(rows[f]) for f in ROW.names)
        found = [np.zeros((2, 0), np.int64)]

        def multiply(x: np.ndarray, y: np.ndarray) -> None:
            """x, y: places among the grams of one list."""
            for i in (x[k : k + block] for k in range(0, len(x), block)):
                for j in (y[k : k + block] for k in range(0, len(y), block)):
                    v, w = row[i][:, None], row[j]
                    both = slack[v] + slack[w]
                    k, m = np.nonzero((c[v] != c[w]) & (slack[v] <= slack[w]) & (both < 0) & (np.minimum(behind[i][:, None], behind[j]) * scale >= -both))
                    v, w = row[i][k], row[j][m]
                    bits = np.bitwise_count(sketch[v] ^ sketch[w]).sum(axis=1, dtype=np.int64)
                    ok = (100 + percent) * bits <= (100 - percent) * (size[v].astype(np.int64) + size[w])
                    found.append(np.stack((v[ok], w[ok])))

        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        last = np.concatenate((first[1:], [len(key)]))
        near, closer, farther = (np.add.reduceat(x.astype(np.int64), first) for x in (role == NEAR, role == CLOSER, role == FARTHER))
        with_near = (near > 0) & (last - first > near)
        with_closer = (closer > 0) & (closer + farther > 1)
        some = (with_near | with_closer | (role[first] == HUB)) & (last - first > 1)
        for a, b, has_near, has_closer in zip(*(x[some].tolist() for x in (first, last, with_near, with_closer))):
            at, kind = np.arange(a, b), role[a:b]
            if kind[0] == HUB:
                them = row[a:b]
                hub = them[np.lexsort((node[them], -slack[them]))[:1]]
                them = them[(slack[them] + slack[hub] >= 0) & (c[them] != c[hub])]
                found.append(np.stack((them, np.broadcast_to(hub, len(them)))))
            else:
                if has_near:
                    multiply(at[kind > NEAR], at[kind == NEAR])
                if has_closer:
                    multiply(at[kind >= FARTHER], at[kind == CLOSER])
        v, w = np.concatenate(found, axis=1)
        v, w = np.where(node[v] < node[w], v, w), np.where(node[v] < node[w], w, v)
        out = np.unique(np.stack((node[v], node[w], c[v], c[w])), axis=1)
        return pa.table([pa.array(x) for x in out], names=["u", "p", "c", "cp"])

    return dealt.groupBy("bucket").applyInArrow(meet, "u long, p long, c long, cp long").distinct()


def resolve(member: DataFrame, sized: DataFrame | None, sets: DataFrame, decode: Decode, percent: int) -> DataFrame:
    """(node, component) of the nodes that link: 100 * |A and B| >= percent * |A or B| within a group.

    member: (gid, u, p); sized: (node, n), or None where sizes rule out little; sets: (node, data) of
    all members. Each row is first compared with its groups' pivots. Where a group's rows are then still
    in different components, the pairs that candidates() does not rule out are compared, too. So every
    pair of a group that links is in one component. This is one path for groups of all sizes.
    """
    stars = member.where("u <> p").select("u", "p").distinct()
    if sized is not None:
        able = F.least("nu", "np") * 100 >= F.greatest("nu", "np") * percent
        stars = stars.join(sized.select(F.col("node").alias("u"), F.col("n").alias("nu")), "u").join(sized.select(F.col("node").alias("p"), F.col("n").alias("np")), "p").where(able)
    stars = materialize(stars.select("u", "p", F.col("u").alias("c"), F.col("p").alias("cp")), "stars")
    links = materialize(link(stars, sets, decode, percent), "links")
    found = connected(links)
    labelled = member.join(found.select(F.col("node").alias("u"), "component"), "u", "left").select("gid", "u", "p", F.coalesce("component", "u").alias("c"))
    mixed = labelled.groupBy("gid").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("n")).where("low <> high AND n > 2").select("gid")
    rest = labelled.join(mixed, "gid", "left_semi").where("u <> p").select("u", "p", "c", F.col("p").alias("cp")).distinct()
    rest = materialize(rest, "rest")
    buckets = int(max(16, min(1 << 20, rest.count() * 64 * GRAM.itemsize // (1 << 22))))
    pairs = materialize(candidates(differences(rest, sets, decode, percent, buckets), percent), "pairs")
    release(stars, links, rest)
    if not pairs.isEmpty():
        more = materialize(link(pairs, sets, decode, percent), "links")
        merged = connected(more)
        after = found.join(merged.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
        whole = materialize(after.union(merged.join(found, "node", "left_anti")), "labels")
        release(found, merged, more)
        found = whole
    release(pairs)
    return found
