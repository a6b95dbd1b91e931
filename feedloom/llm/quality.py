"""Supervised subword embeddings: a document classifier in the manner of bag-of-n-gram text classification."""

from __future__ import annotations

from array import array
from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batched

#: Hash buckets for words and character n-grams; the n-gram lengths; the width of a vector.
BUCKETS, GRAMS, DIM = 1 << 18, (3, 4), 16
#: Most labelled documents that a model is fitted on: those with the least hash of their doc_id.
SAMPLE = 3000
#: Most entries of a worker's cache of words.
CACHE = 400_000


def features(word: str) -> list[int]:
    """Buckets of a word (first) and of its character n-grams, with marks at its ends."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [crc32(x.encode("utf-8", "replace")) % BUCKETS for x in [marked, *grams]]


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct words of some texts (between ASCII white space; null: none), each place's word by number, and where each text's
    places begin and the last's end. A text without words has one place with the empty word."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
    words, offsets = split.flatten().dictionary_encode(), split.offsets.to_numpy()
    return words.dictionary.to_pylist(), words.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and how often each occurs: its words', their character n-grams', and its word
    bigrams', each of which has the exclusive or of its two words' buckets."""
    words, at, _ = split_words(pa.array([text], pa.string()))
    if words == [""]:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    tally: Counter = Counter()
    own = [features(w) for w in words]
    for ids, n in zip(own, np.bincount(at).tolist()):
        for f in ids:
            tally[f] += n
    heads = np.array([ids[0] for ids in own])[at]
    tally.update((heads[:-1] ^ heads[1:]).tolist())
    return np.fromiter(tally.keys(), np.int32, len(tally)), np.fromiter(tally.values(), np.int32, len(tally))


@dataclass
class Model:
    """Vectors of the buckets, and the weights and biases of the softmax layer over two classes."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def lean(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the difference of the two outputs, and the difference of the biases. The mean
        commutes with the output layer, so scoring needs one number a bucket."""
        return (self.vectors @ (self.weights[1] - self.weights[0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def gradients(vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray, ids: np.ndarray, share: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the log-likelihood of ``label``, by the weights, the biases and the vectors ``ids``, which are averaged by ``share``."""
    hidden = share @ vectors[ids] if len(ids) else np.zeros(vectors.shape[1], vectors.dtype)
    out = weights @ hidden + bias
    p = np.exp(out - out.max())
    error = -p / p.sum()
    error[label] += 1
    return np.outer(error, hidden), error, np.outer(share, error @ weights)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, rate: float = 1.0, seed: int = 7) -> Model:
    """Stochastic gradient descent over (buckets, counts, label): a document's vector is the mean of its features' vectors.
    Without examples the model scores 0.5; a document without features teaches the biases only."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    total = max(1, epochs * len(examples))
    done = 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            ids, counts, label = examples[k]
            lr = rate * (1 - done / total)
            done += 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            by_weights, by_bias, by_vectors = gradients(vectors, weights, bias, ids, share, label)
            weights += lr * by_weights
            bias += 0.1 * lr * by_bias
            if len(ids):
                vectors[ids] += (lr * 50) * by_vectors
    return Model(vectors, weights, bias)


def held_out(doc_id) -> F.Column:
    """True for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents that are not held out. A doc_id whose labels are null, other than 0 and
    1, or at odds with each other teaches nothing; of rows that share a doc_id the least text counts."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other").drop("other")
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marks), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            got = [counted(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i.tobytes() for i, _ in got], pa.binary()), pa.array([n.tobytes() for _, n in got], pa.binary())], ["doc_id", "label", "ids", "counts"])

    rows = sorted(texts.mapInArrow(run, "doc_id long, label int, ids binary, counts binary").collect())
    return train([(np.frombuffer(r.ids, np.int32), np.frombuffer(r.counts, np.int32), r.label) for r in rows])


class Scorer:
    """Scores of texts. A word's bucket, its features' sum and their number are kept in a bounded cache, as arrays by the word's
    number; the words of a batch are split and numbered by Arrow, and all else is array arithmetic."""

    def __init__(self, lean: np.ndarray, bias: float):
        self.table, self.lean, self.bias = lean.tolist(), lean, bias
        self.clear()

    def clear(self) -> None:
        self.number, self.heads, self.sums, self.sizes = {"": 0}, array("i", [0]), array("d", [0.0]), array("i", [0])

    def _learn(self, word: str) -> int:
        ids = features(word)
        self.heads.append(ids[0])
        self.sums.append(sum([self.table[i] for i in ids]))
        self.sizes.append(len(ids))
        self.number[word] = k = len(self.heads) - 1
        return k

    def __call__(self, texts: pa.Array) -> np.ndarray:
        words, at, offsets = split_words(texts)
        if len(self.number) > CACHE:
            self.clear()
        get, learn = self.number.get, self._learn
        at = np.array([learn(w) if (k := get(w)) is None else k for w in words], np.int32)[at]
        heads, sums, sizes = (np.frombuffer(c, t)[at] for c, t in ((self.heads, np.int32), (self.sums, np.float64), (self.sizes, np.int32)))
        pair = self.lean[heads[:-1] ^ heads[1:]]
        one = np.ones(len(pair), np.int32)
        for x in (pair, one):
            x[offsets[1:-1] - 1] = 0  # no bigram goes over the end of a text
        starts = offsets[:-1]
        total = np.add.reduceat(sums + np.append(pair, 0.0), starts)
        count = np.add.reduceat(sizes + np.append(one, np.int32(0)), starts, dtype=np.int64)
        x = self.bias + total / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(x, -700.0, 700.0)))


def _scorer(model: Model, spark):
    """A function that gives a worker its scorer; the model's one number a bucket is broadcast."""
    lean, bias = model.lean()
    shared = spark.sparkContext.broadcast(lean)
    return lambda: Scorer(shared.value, bias)


#: Rows that are scored at a time.
STEP = 1024


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted (1 if score >= threshold).

    The whole text and nothing else is scored. Null and empty texts have no features and get the model's prior. Rows that
    repeat score alike; a null doc_id is not held out; other columns are ignored; an empty table gives an empty result.
    The model's one number a bucket (2 MB) is broadcast; the stage is narrow.
    """
    make = _scorer(model, docs.sparkSession)

    def run(batches):
        one = make()
        for b in batched(batches, STEP, one):
            scores = one(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), held_out(doc_id).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores at least ``threshold``; edge cases as in ``score``."""
    make, at = _scorer(model, docs.sparkSession), docs.columns.index("text")

    def run(batches):
        one = make()
        for b in batched(batches, STEP, one):
            yield b.filter(pa.array(one(b.column(at).cast(pa.string())) >= threshold))

    return docs.mapInArrow(run, docs.schema)
