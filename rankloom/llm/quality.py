"""Quality classifier (operator 6): supervised subword embeddings.

A document is the average of learned vectors of its words, word pairs and character n-grams, all hashed into one table of fixed
size; a softmax over the classes follows. Training is stochastic gradient descent in numpy on a bounded sample of labelled documents
(the first TRAIN_ROWS by a hash of doc_id, whole texts). As the output is linear in the average, each table row scores as
one number, and scoring every document is a mean of looked-up numbers. Only the text is ever an input of a score.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import Words, mix, slices, text_bytes, whole_texts

#: Labelled documents that training reads at most.
TRAIN_ROWS = 6000
BUCKETS = 1 << 17
DIM = 16
EPOCHS = 6
RATE = 0.4
CHARS = (3, 4, 5)
SEED = 20
THRESHOLD = 0.3
#: Features of training documents in one array: the system takes arrays of this size back when training ends, which it does not with many small ones.
KEPT = 1 << 23

_PAIR, _CHARS = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text modulo 5 is 0; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


class Features:
    """Hashed features of whole texts: (text number, table row) of every word, word pair and n-gram of a word's bytes.

    A word that follows itself makes the same pair whatever the word."""

    def __init__(self, buckets: int = BUCKETS):
        self.words, self.buckets = Words(lower=False), np.uint64(buckets)
        self.bytes = mix(np.arange(1, 257, dtype=np.uint64) * _CHARS)

    def _row(self, hashes: np.ndarray) -> np.ndarray:
        return (mix(hashes) % self.buckets).astype(np.int32)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, borders = text_bytes(texts)
        first, hashes, starts, ends = self.words.located(data, borders)
        text = np.repeat(np.arange(len(borders) - 1), np.diff(first))
        rows = [self._row(hashes)]
        owner = [text]
        if len(hashes) > 1:
            pair = text[1:] == text[:-1]
            a, b = hashes[:-1][pair], hashes[1:][pair]
            rows.append(self._row(np.where(a == b, _CHARS, a * _PAIR + b)))
            owner.append(text[1:][pair])
        # n-grams of bytes within words, bounded by the word's ends
        if len(data):
            code = self.bytes[data]
            word_of = np.zeros(len(data) + 1, dtype=np.int64)
            word_of[starts] = 1
            word_of = np.cumsum(word_of[:-1])
            inside = np.zeros(len(data) + 1, dtype=np.int8)
            np.add.at(inside, starts, 1)
            np.add.at(inside, ends, -1)
            inside = np.cumsum(inside[:-1]).astype(bool)
            text_of = text[np.maximum(word_of - 1, 0)] if len(text) else word_of
            for n in CHARS:
                if len(data) < n:
                    continue
                size = len(data) - n + 1
                ok = inside[:size] & inside[n - 1 :] & (word_of[:size] == word_of[n - 1 :])
                h = np.zeros(size, dtype=np.uint64)
                for i in range(n):
                    h = h * _PAIR + code[i : i + size]
                rows.append(self._row(h[ok] + np.uint64(n)))
                owner.append(text_of[:size][ok])
        return np.concatenate(owner), np.concatenate(rows)


@dataclass
class Model:
    """``scores``: each table row's part of the log-odds; ``bias``; a document's log-odds is the mean of its features' parts plus the bias."""

    scores: np.ndarray
    bias: float

    def predict(self, owner: np.ndarray, rows: np.ndarray, n_texts: int) -> np.ndarray:
        n = np.bincount(owner, minlength=n_texts)
        z = np.bincount(owner, weights=self.scores[rows], minlength=n_texts) / np.maximum(n, 1) + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))


def train(texts: list[str], labels: np.ndarray, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Softmax over averaged vectors, one document a step, with a falling rate. Without rows of both classes the model scores every text with the share of label 1."""
    labels = np.asarray(labels, dtype=np.int64)
    share = float(labels.mean()) if len(labels) else 0.5
    if not 0 < share < 1:
        return Model(np.zeros(buckets), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    features, docs = Features(buckets), []
    kept, used = (np.empty(0, dtype=np.int32), np.empty(0, dtype=np.float32)), 0
    for a in range(0, len(texts), 64):
        owner, rows = features(pa.array(texts[a : a + 64], pa.large_string()))
        for i in range(len(texts[a : a + 64])):
            ids, n = np.unique(rows[owner == i], return_counts=True)
            if used + len(ids) > len(kept[0]):
                size, used = max(KEPT, len(ids)), 0
                kept = np.empty(size, dtype=np.int32), np.empty(size, dtype=np.float32)
            own = slice(used, used + len(ids))
            kept[0][own], kept[1][own], used = ids, n / max(1, n.sum()), own.stop
            docs.append((kept[0][own], kept[1][own]))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1.0 / dim, 1.0 / dim, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    # both classes weigh the same in total
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, n = docs[i]
            lr = rate * (1 - done / steps)
            done += 1
            mean = n @ table[ids] if len(ids) else np.zeros(dim, dtype=np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            p *= weight[i] * lr
            back = out @ p
            out -= np.outer(mean, p)
            bias -= p
            if len(ids):
                # the average's gradient, per feature scaled as if its count were one of few
                table[ids] -= np.outer(n * min(len(ids), 50), back)
    delta = out[:, 1] - out[:, 0]
    # balanced training scores against even classes; put the share back
    prior = np.log(share / (1 - share))
    return Model((table @ delta).astype(np.float64), float(bias[1] - bias[0] + prior))


def training_sample(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``rows`` documents that are not held out, the first by md5 of doc_id; rows without a label or doc_id are left out.
    Rows that repeat a doc_id count once, by their first text, so the driver never holds more than ``rows`` texts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    wanted = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id")  # at most ``rows`` small rows
    found = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    got = sorted((r["doc_id"], r["text"] or "", r["y"]) for r in found.toLocalIterator())
    return [g[1] for g in got], np.array([g[2] for g in got], dtype=np.int64)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row; a null or empty text has no features and scores by the bias."""
    shared = docs.sparkSession.sparkContext.broadcast((model.scores, model.bias))  # BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, use = Features(len(shared.value[0])), Model(*shared.value)
        for b in slices(batches, "text", 1 << 20):
            owner, rows = features(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array(use.predict(owner, rows, b.num_rows))], names=["doc_id", "score"])

    return whole_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    model = train(*training_sample(docs, labels, target))
    shared = docs.sparkSession.sparkContext.broadcast((model.scores, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, use = Features(len(shared.value[0])), Model(*shared.value)
        for b in slices(batches, "text", 1 << 20):
            owner, rows = features(b.column("text"))
            yield b.filter(pa.array(use.predict(owner, rows, b.num_rows) >= threshold))

    return whole_texts(docs).mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, target: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; repeated rows score alike, an empty table gives no rows."""
    model = train(*training_sample(docs, labels, target))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
