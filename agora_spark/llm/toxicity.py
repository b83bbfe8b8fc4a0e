"""Toxicity: averaged subword embeddings under a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams and of itself (hashed to buckets), so an
unseen spelling shares most of its vectors with known ones. A window of words is the mean of its
words. Embeddings and softmax are trained together by Adam on windows that carry their document's
label; most windows of a toxic document look like any other, so the few that do not stand out. A
document's score is that of its highest window, calibrated by a logistic curve on documents that the
training did not see. The softmax is linear in the mean, so scoring needs one number per bucket.

The model is fitted on a bounded sample: at most max_documents labelled documents, drawn by a hash of
doc_id, and of each at most per_toxic or per_clean windows. Subwords seen fewer than `least` times in
it have no vector.
Scoring reads every window of every whole text.

Defined results: null texts are empty; an empty text gets the score of a window without evidence. A
document whose label is null or missing is not learnt from; several labels of a document count as
their maximum. Without labelled documents of both kinds every score is the share of toxic ones
(0 if none). Repeated rows give repeated results, null ids are kept. Empty tables give empty tables.
Of the documents only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora_spark.llm.common import lean

PUNCTUATION = ".,;:!?\"()[]\n\t"
WINDOW = 12
SIZES = (3, 4, 5)


def words_of(text: str) -> list[str]:
    text = text.lower()
    for c in PUNCTUATION:
        text = text.replace(c, " ")
    words = text.split()
    return [w for w, before in zip(words, [None, *words]) if w != before]  # a word said over and over counts once


def subwords(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all words' n-grams after one another, and how many each word has."""
    joined = "".join(f"<{w}>" for w in words)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.array([len(w) + 2 for w in words], np.int64)
    word = np.repeat(np.arange(len(words)), length)
    found, owner = [], []
    total = np.zeros(len(words), np.uint64)
    np.add.at(total, word, (points + np.uint64(7)) * (np.uint64(0x9E3779B97F4A7C15) ** ((np.arange(len(points)) - np.repeat(np.cumsum(length) - length, length)) % 61 + 1).astype(np.uint64)))
    found.append(total)
    owner.append(np.arange(len(words)))
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(SIZES) + 1):
        h = h[: len(points) - n + 1] * np.uint64(1_000_003) + points[n - 1 :] + np.uint64(n)
        if n in SIZES and len(h):
            inside = word[: len(h)] == word[n - 1 :]
            found.append(h[inside])
            owner.append(word[: len(h)][inside])
    found, owner = np.concatenate(found), np.concatenate(owner)
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(32)
    order = np.argsort(owner, kind="stable")
    return (found[order] % np.uint64(buckets)).astype(np.int64), np.bincount(owner, minlength=len(words))


@dataclass(frozen=True)
class Model:
    """Everything that scoring needs."""

    weights: np.ndarray  # float32, by bucket: a subword's part of the difference of the two logits
    bias: float
    slope: float  # calibration: probability = sigmoid(slope * logit + shift)
    shift: float


class Scorer:
    """Scores texts; keeps up to `keep` words' parts, forgetting all when it is full."""

    def __init__(self, model: Model, keep: int = 150_000):
        self.model, self.keep, self.known = model, keep, {}

    def logits(self, texts: list[str]) -> np.ndarray:
        """The highest window's logit of each text."""
        split = [words_of(t) for t in texts]
        if len(self.known) > self.keep:
            self.known = {}
        new = list(set().union(*split).difference(self.known)) if split else []
        for a in range(0, len(new), 50_000):
            part = new[a : a + 50_000]
            at, count = subwords(part, len(self.model.weights))
            means = np.add.reduceat(self.model.weights[at].astype(np.float64), np.cumsum(count) - count) / count
            self.known.update(zip(part, means.tolist()))
        out = np.full(len(texts), self.model.bias)
        for k, words in enumerate(split):
            if words:
                value = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
                total = np.concatenate(([0.0], np.cumsum(value)))
                width = min(WINDOW, len(words))
                out[k] += (total[width:] - total[:-width]).max() / WINDOW  # a short text is a window with empty places
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        z = self.model.slope * self.logits(texts) + self.model.shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train_windows(windows: list[str], labels: np.ndarray, buckets: int, dim: int, epochs: int, rate: float, decay: float, least: int, seed: int) -> tuple[np.ndarray, float]:
    """Fit embeddings and softmax jointly; returns each bucket's part of the logit difference, and the bias."""
    rng = np.random.default_rng(seed)
    split = [words_of(w) or [""] for w in windows]
    index: dict[str, int] = {}
    word = np.array([index.setdefault(w, len(index)) for ws in split for w in ws], np.int64)
    length = np.array([len(ws) for ws in split], np.int64)
    least = int(np.clip(len(split) // 2_000, 1, least))
    begin, owner = np.cumsum(length) - length, np.repeat(np.arange(len(split)), length)
    sub, n_sub = subwords(list(index), buckets)
    sub_begin, sub_owner = np.cumsum(n_sub) - n_sub, np.repeat(np.arange(len(index)), n_sub)
    seen = np.bincount(sub, np.bincount(word, minlength=len(index))[sub_owner], buckets)
    used = np.flatnonzero(seen >= least)  # rarer subwords would only be learnt by heart
    slot = np.full(buckets, len(used), np.int64)
    slot[used] = np.arange(len(used))
    sub = slot[sub]
    table = rng.normal(0, 0.1, (len(used) + 1, dim))
    table[-1] = 0
    soft, bias = rng.normal(0, 0.3, (dim, 2)), np.zeros(2)
    target = np.eye(2)[labels]
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))[:, None]
    params = [table, soft, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        mean = np.stack([np.add.reduceat((np.add.reduceat(table[sub, d], sub_begin) / n_sub)[word], begin) for d in range(dim)], axis=1) / WINDOW
        z = mean @ soft + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        dz = (p - target) * weight
        dmean = (dz @ soft.T) / WINDOW
        dtable = np.stack([np.bincount(sub, (np.bincount(word, dmean[owner, d], len(index)) / n_sub)[sub_owner], len(used) + 1) for d in range(dim)], axis=1)
        dtable[-1] = 0
        for p_, g, m, v in zip(params, (dtable + decay * table, mean.T @ dz, dz.sum(axis=0)), first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
    weights = np.zeros(buckets, np.float32)
    weights[used] = table[:-1] @ (soft[:, 1] - soft[:, 0])
    return weights, float(bias[1] - bias[0])


def calibrate(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve (Newton's method with a little shrinkage)."""
    middle, spread = logits.mean(), logits.std() + 1e-9
    x = np.stack([(logits - middle) / spread, np.ones_like(logits)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (p - labels) + 1e-2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w -= np.linalg.solve(h, g)
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_documents: int = 16_000, per_toxic: int = 40, per_clean: int = 6, buckets: int = 1 << 18, dim: int = 8, epochs: int = 30, rate: float = 0.05, decay: float = 1e-5, least: int = 20, seed: int = 11) -> Model:
    """Train on the labelled documents (doc_id, text; doc_id, toxic) for which learn, a condition on doc_id, holds."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    if learn is not None:
        known = known.where(learn)
    lot = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = 1.0 if counts.get(1) else 0.0
        return Model(np.zeros(buckets, np.float32), 0.0, 0.0, 40.0 if share else -40.0)
    drawn = known.where(lot < int(1_000_000 * min(1.0, 0.95 * max_documents / total)))
    # The drawn labels are about max_documents rows at most, two numbers each, so the texts need no shuffle.
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = rows.select("text", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(5)) == 0).alias("apart"), F.col("doc_id").cast("long").alias("doc_id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, 256) for whole in batches for a in range(0, len(whole), 256)):
            out = [], []
            for text, toxic, apart, doc in zip(*(c.to_pylist() for c in batch.columns)):
                if apart:
                    continue
                words = words_of(text)
                starts = np.arange(0, max(1, len(words)), WINDOW)
                most = per_toxic if toxic else per_clean
                if len(starts) > most:
                    starts = np.sort(np.random.default_rng(doc & 0x7FFFFFFF).choice(starts, most, replace=False))
                out[0].extend(" ".join(words[a : a + WINDOW]) for a in starts.tolist())
                out[1].extend([toxic] * len(starts))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32())], names=["words", "toxic"])

    sample = rows.mapInArrow(lean(cut), "words string, toxic int").toArrow()
    y = sample.column("toxic").to_numpy()
    weights, bias = train_windows(sample.column("words").to_pylist(), y, buckets, dim, epochs, rate, decay, least, seed)
    raw = Model(weights, bias, 1.0, 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(raw)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in (whole.slice(a, 256) for whole in batches for a in range(0, len(whole), 256)):
            z = scorer.logits(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(z), batch.column(1).cast(pa.int32())], names=["z", "toxic"])

    seen = rows.where("apart").select("text", "toxic").mapInArrow(lean(measure), "z double, toxic int").toArrow()
    z, y = seen.column("z").to_numpy(), seen.column("toxic").to_numpy()
    slope, shift = calibrate(z, y) if len(y) and 0 < y.sum() < len(y) else (1.0, 0.0)
    shared.unpersist()
    return Model(weights, bias, max(slope, 0.0), shift)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep and score double (0 to 1) of every row, from its whole text. A column named score is replaced."""
    keep = tuple(c for c in keep if c != "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep] if "text" in keep else [*keep, "text"]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                value = scorer.scores([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(value, pa.float64())], names=[*keep, "score"])

    rows = docs.select(*(F.col(f"`{c}`") for c in names))
    kinds = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip(keep, rows.schema))
    return rows.mapInArrow(lean(run), f"{kinds}, score double")
