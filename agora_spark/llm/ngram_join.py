"""Documents whose word n-gram sets are alike: a blocked sparse matrix product below exact bounds.

A document is a row of the incidence matrix, a set of hashed n-grams. The product of the matrix with
itself counts overlaps; only rows that could reach the wanted Jaccard share are multiplied:

1. Equal sets are one node (a 64-bit digest), so copies cost nothing further.
2. Size-derived bound on the difference: if 100*|A and B| >= percent*|A or B|, at most
   D = (100 - percent)/percent * |A| n-grams differ. n-grams are dealt into more than D parts by their
   hash; some part of both sets is then equal and not empty. Parts meet in buckets by a hash of their
   content (a blocked, packed inverted index), and rows that share a part make a group. Frequent
   passages do no harm: a part is shared only with all its n-grams, and as rows that link share all
   but D parts, each row leaves its most frequent parts and meets others in its D + 1 rarest. Sets are
   compared within a class of sizes and with the next one, as the bound on sizes allows.
3. In each group every row is multiplied with one pivot: overlaps are accumulated over the sorted
   n-grams of a block of rows at once, and pairs below the bound are discarded. What remains are links,
   which distributed union-find makes components of.
4. Where rows of a group are still apart, the sparse matrix of their differences from the pivot is
   multiplied with itself, gram by gram and in blocks: only rows of different components that share one
   of their rarer differences meet, and pairs are discarded by the number of differences that are left
   to share and by odd sketches. What remains is compared exactly. No link between different sets is
   missed that would join two components, and no group emits all its pairs.

Only D (id, size, digest), groups of digests and links are written; sets are made again from the texts
of those documents that share a part with another.

Defined results: see the contract in link_documents(). Null and empty texts, and texts of blanks only,
have an empty set and link with nothing; rows with a null id take part, but a component is named by the
smallest id that is not null (null if there is none). Repeated rows and ids are allowed. Empty tables
give empty tables. Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora_spark.llm.common import lean, materialize, release
from agora_spark.llm.overlap import ENTRY, _mix, deal, digest, groups, resolve

ODD1, ODD2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
BATCH = 1 << 18
#: Parts per difference that the bound allows, so that enough of them are not empty.
SPARE = 1.3


def _all_powers(base: int, most: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(most - 1, base, np.uint64))))


@lru_cache(4)
def _usual_powers(base: int) -> np.ndarray:
    return _all_powers(base, BATCH + 1)


def _powers(base: int, n: int) -> np.ndarray:
    return _usual_powers(base)[:n] if n <= BATCH + 1 else _all_powers(base, n)


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts in one UTF-8 buffer, and how many each text has; A-Z count as a-z.

    A word's hash is a difference of running sums, scaled back by the inverse power of its place.
    """
    n = len(data)
    lower = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    word = (data != 32) & ((data < 9) | (data > 13))
    first = np.zeros(n + 1, bool)
    first[ends[:-1]] = True  # a text's start begins a word
    first[0] = True
    before = np.concatenate(([False], word[:-1])) & ~first[:n]
    start = np.flatnonzero(word & ~before)
    stop_mask = word & ~(np.concatenate((word[1:], [False])) & ~first[1:])
    stop = np.flatnonzero(stop_mask) + 1
    out = np.zeros(len(start), np.uint64)
    for base in (ODD1 | 1, ODD2 | 1):
        power, back = _powers(base, n + 1), _powers(pow(base, -1, 1 << 64), n + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * power[:n])))
        out = _mix(out + (total[stop] - total[start]) * back[start])
    return out + (stop - start).astype(np.uint64), np.diff(np.searchsorted(start, np.concatenate(([0], ends))))


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted hashes of the different n-grams of `width` words of each text; fewer words make one n-gram."""
    texts = texts.fill_null("")
    sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    out: list[np.ndarray] = []
    through = np.cumsum(sizes)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(through, (through[a - 1] if a else 0) + BATCH, "right")))
        part = texts.slice(a, b - a).to_pylist()
        raw = [t.encode("utf-8", "surrogatepass") for t in part]
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        words, count = word_hashes(data, ends) if len(data) else (np.zeros(0, np.uint64), np.zeros(len(raw), np.int64))
        grams = words[: max(0, len(words) - width + 1)].copy()
        for j in range(1, width):
            grams = _mix(grams * np.uint64(ODD1) + words[j : j + len(grams)])
        begin = np.cumsum(count) - count
        for s, n in zip(begin.tolist(), count.tolist()):
            if n >= width:
                g = np.sort(grams[s : s + n - width + 1])
                out.append(g[np.concatenate(([True], g[1:] != g[:-1]))])
            elif n:
                h = np.array([n], np.uint64)
                for k in range(s, s + n):
                    h = _mix(h * np.uint64(ODD2) + words[k : k + 1])
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
        a = b
    return out


class Scheme:
    """Classes of sizes, and the parts of each, for a Jaccard share of percent / 100."""

    def __init__(self, percent: int):
        self.percent, self.bounds = percent, [1]

    def _extend(self, n: int, classes: int = 0) -> None:
        while self.bounds[-1] <= n or len(self.bounds) < classes:
            self.bounds.append(max(self.bounds[-1] + 1, -(-self.bounds[-1] * 100 // self.percent)))

    def class_of(self, n: int) -> int:
        self._extend(n)
        return bisect_right(self.bounds, n) - 1

    def parts(self, c: int) -> tuple[int, int]:
        """How many n-grams may differ when the smaller set is of class c, and the number of parts."""
        self._extend(0, c + 2)
        most = (100 - self.percent) * (self.bounds[c + 1] - 1) // self.percent
        return most, 1 if most == 0 else math.ceil(SPARE * (most + 1))

    def signatures(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the parts' contents, for the set's class and the one below, and how many parts of each class are to spare."""
        own = self.class_of(len(grams))
        out, spares = [], []
        for c in (own, own - 1) if own else (own,):
            most, parts = self.parts(c)
            place = (grams >> np.uint64(20)) % np.uint64(parts) if parts > 1 else np.zeros(len(grams), np.uint64)
            place = place.astype(np.int64)
            low = np.bincount(place, (grams & np.uint64(0xFFFFFFFF)).astype(np.float64), parts).astype(np.uint64)
            high = np.bincount(place, (grams >> np.uint64(32)).astype(np.float64), parts).astype(np.uint64)
            used = np.flatnonzero(np.bincount(place, minlength=parts))
            spare = max(0, len(used) - most - 1)
            if len(used) <= most:  # too few parts to be sure of an equal one that is not empty
                used = np.arange(parts)
            sign = _mix((low[used] + _mix(high[used] + np.uint64(ODD2))) * np.uint64(ODD1) + np.uint64(c) * np.uint64(1 << 32) + used.astype(np.uint64))
            out.append(sign & ~np.uint64(1 << 32) | np.uint64((c & 1) << 32))
            spares.append(np.full(len(used), spare))
        return np.concatenate(out), np.concatenate(spares)


def _long(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def nodes_of(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, node) of each document; node is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s.tobytes()) if len(s) else None for s in sets], pa.int64())], names=["doc_id", "n", "node"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, node long")


def entries_of(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """(bucket, entries): the nodes by the parts' signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = Scheme(percent)

        def signs() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            seen: set[int] = set()
            for batch in batches:
                for s in shingle_sets(batch.column(0), width):
                    if len(s) and (node := digest(s.tobytes())) not in seen:
                        if len(seen) < 1_000_000:
                            seen.add(node)  # copies within a task
                        sign, spare = scheme.signatures(s)
                        yield sign, np.full(len(sign), node, np.uint64), spare

        yield from deal(signs(), buckets)

    return docs.select("text").mapInArrow(lean(run), "bucket long, entries binary")


def link_documents(docs: DataFrame, width: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", parallel: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Two documents link when 100 * |A and B| >= percent * |A or B| for their sets of different n-grams
    of `width` lower-cased words (the whole sequence where there are fewer). component_id is the
    smallest id reachable by links, its own included.
    """
    docs = _long(docs, id_col, text_col)
    nodes = materialize(nodes_of(docs, width), "nodes")
    entries = (nodes.agg(F.sum("n")).first()[0] or 0) * 0.5 * ENTRY.itemsize
    buckets = int(max(parallel or 16, min(1 << 20, entries // (1 << 21))))
    member = groups(entries_of(docs, width, percent, buckets))
    holder = member.select(F.col("u").alias("node")).distinct().join(nodes.where("doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "node")
    # A node of documents without ids only is read by its text, too.
    texts = docs.where("text IS NOT NULL").join(holder.select("doc_id").hint("shuffle_hash"), "doc_id", "left_semi")  # texts are not sorted
    texts = texts.unionByName(docs.where("doc_id IS NULL AND text IS NOT NULL"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [s for s in shingle_sets(batch.column(0), width) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(s.tobytes()) for s in keep], pa.int64()), pa.array([s.tobytes() for s in keep], pa.binary())], names=["node", "data"])

    sets = materialize(texts.select("text").mapInArrow(lean(encode), "node long, data binary").dropDuplicates(["node"]), "sets")
    sized = nodes.where("node IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"))
    found = resolve(member, sized, sets, lambda data: [np.frombuffer(x.as_py(), np.uint64) for x in data], percent)
    release(member, sets)
    # From nodes to documents: the smallest id of a component's documents.
    named = nodes.join(found, "node", "left").select("doc_id", "n", "node", F.coalesce("component", "node").alias("c"))
    smallest = named.where("c IS NOT NULL").groupBy("c").agg(F.min("doc_id").alias("smallest"))
    out = named.join(smallest, "c", "left")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("smallest")).alias("component_id"))
