"""Fuzzy line dedup: of lines that are alike, over all documents, only the first one stays.

Lines are compared without case and with runs of blanks as one. Each different line gets a MinHash
signature of its character shingles; bands of the signature that agree make groups of candidates, the
exact Jaccard likeness of the shingle sets verifies them, and distributed union-find makes components.
The first line of each component, by document id and place, stays; the others are cut out.

With 10 bands of 4 rows a pair of likeness 0.8 meets with probability 0.995, one of 0.9 with 0.99999.
Equal lines are one node from the start; a group's rows are compared with pivots, not all with all.

Defined results: lines are what stands between newlines; blank lines always stay and are no
duplicates. Lines shorter than a shingle are one shingle, so they are alike only if they are equal.
Null texts are empty. Null ids come last. Rows with the same id and text are one document repeated and
share the result; rows with the same id and different texts are different documents. Empty tables give
empty tables. Columns other than id and text are passed through under their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora_spark.llm.common import lean, materialize, release
from agora_spark.llm.overlap import ENTRY, _mix, deal, digest, groups, resolve

SHINGLE, BANDS, ROWS = 8, 10, 4
ODD = 0x9E3779B97F4A7C15


def normal(line: str) -> str:
    """A line in lower case with single blanks; most lines have no others, which costs less to see than to mend."""
    low = line.lower()
    return low if "  " not in line and line.isprintable() and line[:1] != " " and line[-1:] != " " else " ".join(low.split())


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles' hashes of all lines after one another (not yet distinct), and how many each line has. No line is empty."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.array([len(x) for x in lines], np.int64)
    h, width, power = points + np.uint64(1), 1, pow(ODD, 1, 1 << 64)
    while width < SHINGLE:
        h = h[: len(h) - width] * np.uint64(power) + h[width:] if len(h) > width else h[:0]
        width, power = 2 * width, power * power % (1 << 64)
    count = np.maximum(length - SHINGLE + 1, 1)
    kind = np.int32 if len(points) < 1 << 30 else np.int64
    skipped = np.cumsum(length) - length - (np.cumsum(count) - count)
    at = np.repeat(skipped.astype(kind), count)
    at += np.arange(len(at), dtype=kind)
    out = h.take(at, mode="clip") if len(h) else np.zeros(len(at), np.uint64)
    short = np.flatnonzero(length < SHINGLE)
    if len(short):
        out[(np.cumsum(count) - count)[short]] = [digest(lines[k].encode("utf-8", "surrogatepass")) for k in short.tolist()]
    return _mix(out), count


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    h, count = shingles(lines)
    out = []
    for part in np.split(h, np.cumsum(count)[:-1]):
        s = np.sort(part)
        out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
    return out


@lru_cache
def _factors(seed: int) -> np.ndarray:
    """For each row of each band an odd factor, which puts hashes in another order."""
    return np.random.default_rng(seed).integers(0, 1 << 32, (BANDS, ROWS), np.uint32) | np.uint32(1)


def signatures(lines: list[str], seed: int = 5) -> np.ndarray:
    """(lines, BANDS): the bands' hashes."""
    h, count = shingles(lines)
    first = np.cumsum(count) - count
    low = (h >> np.uint64(32)).astype(np.uint32)
    turned = np.empty_like(low)
    out = np.empty((len(lines), BANDS), np.uint64)
    for band, factors in enumerate(_factors(seed)):
        key = np.full(len(lines), band + 1, np.uint64)
        for factor in factors:
            np.multiply(low, factor, out=turned)
            key = key * np.uint64(ODD) + np.minimum.reduceat(turned, first)
        out[:, band] = _mix(key)
    return out


def _pack(items: list, most: int = 1 << 17) -> Iterator[list]:
    """Runs of (node, line) of about `most` characters, whose hashes fit in a core's cache."""
    held, size = [], 0
    for item in items:
        held.append(item)
        size += len(item[1])
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def dedup_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text of the lines that stay, and n_lines and n_removed (longs)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("long"), text).alias("key"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every line's place, and the line itself where the task has not met it before (or has forgotten it)."""
        known: dict[str, int] = {}
        for batch in batches:
            for a in range(0, len(batch), 500):
                out: list[list] = [[], [], [], [], []]
                docs_, keys, places, nodes, texts = out
                for doc, key, t in zip(*(c.to_pylist() for c in batch.slice(a, 500).columns)):
                    before = len(places)
                    for k, raw in enumerate(t.split("\n")):
                        if line := normal(raw):
                            node, data = known.get(line), None
                            if node is None:
                                node, data = digest(line.encode("utf-8", "surrogatepass")), line
                                if len(known) < 100_000:
                                    known[line] = node
                            places.append(k)
                            nodes.append(node)
                            texts.append(data)
                    docs_.extend([doc] * (len(places) - before))
                    keys.extend([key] * (len(places) - before))
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.string())], names=["id", "key", "place", "node", "data"])

    found_at = materialize(rows.select("id", "key", "text").mapInArrow(lean(read), "id long, key long, place int, node long, data string"), "places")
    lines = found_at.where("data IS NOT NULL").select("node", "data")
    n_entries = found_at.count() * BANDS  # at most; the count needs no column
    buckets = int(max(16, min(1 << 20, n_entries * ENTRY.itemsize // (1 << 21))))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def signs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                for part in _pack(list(zip(*(c.to_pylist() for c in batch.columns)))):
                    yield signatures([x for _, x in part]).ravel(), np.repeat(np.array([n for n, _ in part], np.uint64), BANDS), np.zeros(len(part) * BANDS, np.int64)

        yield from deal(signs(), buckets)

    member = groups(lines.mapInArrow(lean(sign), "bucket long, entries binary"))
    needed = lines.join(member.select(F.col("u").alias("node")).distinct().hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"])
    needed = materialize(needed.select("node", F.col("data").cast("binary").alias("data")), "needed")
    found = resolve(member, None, needed, lambda data: shingle_sets([x.decode() for x in data.to_pylist()]), percent)
    release(member, needed)
    # Lines that are there once and like no other have no further part.
    order = F.struct(F.col("id").isNull().alias("last"), "id", "key", "place")
    once = found_at.groupBy("node").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    again = materialize(once.join(found, "node", "left").where("n > 1 OR component IS NOT NULL").select("node", "first", F.coalesce("component", "node").alias("c")), "again")
    firsts = again.select("node", "c").join(again.groupBy("c").agg(F.min("first").alias("first")), "c").select("node", "first")
    gone = found_at.select("key", "place", "node").join(firsts.hint("shuffle_hash"), "node").where((F.col("first.key") != F.col("key")) | (F.col("first.place") != F.col("place")))
    cuts = gone.groupBy(F.col("key").alias("_key")).agg(F.sort_array(F.collect_set("place")).alias("_cut"))
    # A flag for each line up to the last one that goes, so that each line costs one look.
    runs = F.transform("_cut", lambda c, i: F.array_append(F.array_repeat(F.lit(False), c - F.coalesce(F.get("_cut", i - 1), F.lit(-1)) - 1), F.lit(True)))
    cuts = cuts.select("_key", F.flatten(runs).alias("_gone"), F.size("_cut").cast("long").alias("_n"))
    whole = rows.join(cuts.hint("shuffle_hash"), rows.key == cuts._key, "left")
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, i: ~F.coalesce(F.get("_gone", i), F.lit(False))), "\n")
    n_lines = (F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long")
    columns = [F.when(F.col("_n").isNull(), F.col("text")).otherwise(kept).alias(text_col) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")]
    return whole.select(*columns, n_lines.alias("n_lines"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_removed"))
