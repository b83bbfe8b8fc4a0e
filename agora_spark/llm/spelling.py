"""Spelling variants: words one edit apart, found by walking automata through tries.

Words are counted with Spark. The sorted vocabulary is divided into shards of a bounded size, each
packed by an executor as a compact trie. Shards are broadcast one after another; each word's
Levenshtein automaton for distance one (a set of states as two bit masks: places reached without an
edit, and with one) walks each shard depth first, follows only children that leave a state alive, and
emits the words at which it accepts. Counts and the best form of each word are reduced over the shards.

Shards are ranges of the sorted words, so most automata die at the first letters of a foreign shard.
A shard holds at most SHARD_WORDS words and SHARD_CHARS letters (or one longer word), which bounds the
trie's nodes and so what is broadcast; the driver holds one shard at a time.

Defined results: null texts have no words; a null id counts as an empty string. Words are runs of
A-Z, a-z and the letters of Latin-1 from U+00C0 to U+00FF, of at least 6 code points that occur at
least 5 times, repeated rows included. Ties of forms go to the smallest word. Forms are at least five
times as frequent as their words, so that chains of forms end. Empty tables give empty tables. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora_spark.llm.common import lean, materialize, release

#: Bounds of a shard.
SHARD_WORDS, SHARD_CHARS = 1 << 17, 1 << 21
SHORTEST, RAREST, TIMES, EVERY = 6, 5, 5, 199
LETTERS = "A-Za-zÀ-ÿ"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words of all texts; where 199 divides the checksum of `id:run`, the run loses a letter first."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{SHORTEST},}}"), F.lit(0))).alias("run"))
    size = F.char_length("run")
    lower = F.when(F.octet_length("run") == size, F.lower("run")).otherwise(F.translate("run", UPPER, UPPER.lower()))
    hashed = runs.select("id", lower.alias("run")).select("run", F.crc32(F.concat("id", F.lit(":"), F.col("run"))).alias("h"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = hashed.select(F.when(F.pmod(F.col("h"), F.lit(EVERY)) == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= RAREST)


class Trie:
    """A trie in arrays. Nodes are numbered by depth, then in order, so a node's children follow one another.

    labels: the letter into node k + 1, at place k; starts: the place of a node's first child;
    ends: the word that ends at a node, plus 1, or 0.
    """

    def __init__(self, labels: bytes, starts: memoryview, ends: memoryview, n: memoryview, words: list[bytes]):
        self.labels, self.starts, self.ends, self.n, self.words = labels, starts, ends, n, words

    @staticmethod
    def pack(words: list[bytes], n: list[int]) -> bytes:
        """Sorted words and their counts as one binary."""
        length = np.array([len(w) for w in words], np.int64)
        text = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(length) - length
        group = np.zeros(len(words), np.int64)  # each word's node at the depth before
        ends = [np.zeros(1, np.uint32)]
        labels, parents, first = [], [], 0
        alive = np.arange(len(words))
        depth = 0
        while len(alive := alive[length[alive] > depth]):
            letter, before = text[begin[alive] + depth], group[alive]
            new = np.concatenate(([True], (letter[1:] != letter[:-1]) | (before[1:] != before[:-1])))
            node = np.cumsum(new) - 1
            labels.append(letter[new])
            parents.append(before[new] + first)
            group[alive] = node
            end, done = np.zeros(node[-1] + 1, np.uint32), length[alive] == depth + 1
            end[node[done]] = alive[done] + 1
            ends.append(end)
            first = first + (len(ends[-2]) if depth else 1)
            depth += 1
        label, parent, end = (np.concatenate(x) if x else np.zeros(0, np.uint8) for x in (labels, parents, ends))
        starts = np.searchsorted(parent, np.arange(len(end) + 1)).astype(np.uint32)
        head = np.array([len(words), len(end), len(text)], np.uint64)
        return b"".join(x.tobytes() for x in (head, np.array(n, np.uint64), starts, end.astype(np.uint32), length.astype(np.uint32), label.astype(np.uint8), text))

    @staticmethod
    def unpack(data: bytes) -> Trie:
        view, at = memoryview(data), 24
        many, nodes, _ = view[:24].cast("Q")
        parts = []
        for kind, size in (("Q", 8 * many), ("I", 4 * (nodes + 1)), ("I", 4 * nodes), ("I", 4 * many), ("B", nodes - 1)):
            parts.append(view[at : at + size].cast(kind))
            at += size
        n, starts, ends, length, labels = parts
        words, text = [], bytes(view[at:])
        at = 0
        for size in length:
            words.append(text[at : at + size])
            at += size
        return Trie(bytes(labels), starts, ends, n, words)

    def near(self, word: bytes) -> list[int]:
        """Places of the words at distance one exactly."""
        labels, starts, ends = self.labels, self.starts, self.ends
        size, full = len(word), (2 << len(word)) - 1
        masks: dict[int, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        found, stack = [], [(0, 1, 2)]  # a node, places reached without an edit, and with one
        while stack:
            node, exact, edited = stack.pop()
            if ends[node] and edited >> size & 1 and not exact >> size & 1:
                found.append(ends[node] - 1)
            a, b = starts[node], starts[node + 1]
            if exact:
                for k in range(a, b):
                    mask = masks.get(labels[k], 0)
                    now = (exact & mask) << 1
                    then = ((edited & mask) << 1 | exact | exact << 1 | now << 1) & full
                    if now or then:
                        stack.append((k + 1, now, then))
            else:  # only the letters that come next can follow
                tried, left = 0, edited & ~(1 << size)
                while left:
                    c = word[left.bit_length() - 1]
                    mask = masks[c]
                    left &= ~mask
                    if not tried >> c & 1:
                        tried |= 1 << c
                        k = labels.find(c, a, b)
                        if k >= 0:
                            stack.append((k + 1, 0, (edited & mask) << 1))
        return found


def shards(vocabulary: DataFrame, parts: int) -> DataFrame:
    """(shard, trie): the vocabulary's tries, packed where its ranges are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, n, size = [], [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([Trie.pack(words, n)], pa.binary())], names=["trie"])
        for batch in batches:
            for word, k in zip(*(c.to_pylist() for c in batch.columns)):
                if words and (len(words) >= SHARD_WORDS or size + len(word) > SHARD_CHARS):
                    yield pack()
                    words, n, size = [], [], 0
                words.append(word.encode("latin-1"))
                n.append(k)
                size += len(word)
        if words:
            yield pack()

    # As few shards as their bounds allow, in however many partitions the ranges come: each shard is a pass over the words.
    ranged = vocabulary.select("word", "n").repartitionByRange(parts, "word").coalesce(parts).sortWithinPartitions("word")
    return ranged.mapInArrow(lean(run), "trie binary").withColumn("shard", F.monotonically_increasing_id())


def _walk(vocabulary: DataFrame, packed) -> DataFrame:
    """(word, near, best, best_n) of the words that have neighbours in one shard; packed: its broadcast trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = None
        for batch in batches:
            trie = trie or Trie.unpack(packed.value)
            out: list[list] = [[], [], [], []]
            for word in batch.column(0).to_pylist():
                if found := trie.near(word.encode("latin-1")):
                    best = min(found, key=lambda k: (-trie.n[k], k))
                    for column, x in zip(out, (word, len(found), trie.words[best].decode("latin-1"), trie.n[best])):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, (pa.string(), pa.int64(), pa.string(), pa.int64()))], names=["word", "near", "best", "best_n"])

    return vocabulary.select("word").mapInArrow(lean(run), "word string, near long, best string, best_n long")


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n): how many words are one edit away, and the most frequent one of them, of words that have any."""
    spark, many = vocabulary.sparkSession, vocabulary.count()
    tries = materialize(shards(vocabulary, max(1, -(-many // SHARD_WORDS))), "tries")
    ids = sorted(r.shard for r in tries.select("shard").collect())  # a number for each 131072 words
    spread = vocabulary.repartition(max(spark.sparkContext.defaultParallelism, many // 8192))
    found = None
    for shard in ids:
        packed = spark.sparkContext.broadcast(bytes(tries.where(F.col("shard") == shard).first().trie))
        part = materialize(_walk(spread, packed), "near")
        packed.destroy()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("b")
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.minus")).alias("best_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling: a chain has at most as many links as counts can be multiplied by five."""
    pointers = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = pointers.select(F.col("word").alias("via"), F.col("root").alias("further"))
        fresh = materialize(pointers.join(further, F.col("root") == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        release(pointers)
        if fresh.where("moved").isEmpty():
            return fresh.select("word", "root")
        pointers = fresh.select("word", "root")
        pointers._agora_path = fresh._agora_path


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of docs."""
    vocabulary = materialize(counted(docs, id_col, text_col), "words")
    near = vocabulary.join(neighbours(vocabulary), "word", "left")
    frequent = F.col("best_n") >= TIMES * F.col("n")
    formed = materialize(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(formed.where("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
