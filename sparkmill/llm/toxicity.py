"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, pairs of neighbours,
and pairs with one word between them (ASCII letters lower-cased, punctuation
left out). Every coordinate has its own rate, and L1 keeps most weights at zero:
what travels to the executors are the few that are not. Training learns from at
most ``max_rows`` labelled ids, in the order of a hash of the id, and stops
before the one with which their features would exceed ``max_features``: both
bound what the driver holds (24 MB as given). Texts are scored whole, always.

Defined results: null and empty texts have the score of the bias alone; rows
without a label or a text are not learned from; an id with several labels is
toxic if any says so, and of an id's several texts the one of smallest hash is
learned from; without labels every score is 0.5; texts of any length are read
whole; a null id is not held out; repeated rows give a row each; an empty table
gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm import common
from sparkmill.llm.textkit import U, mix, owners, slices

BITS = 20
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 6.0, 0.0, 6
THRESHOLD = 0.7
#: Everything ASCII that is no letter or digit separates words here.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(s) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of every occurrence in a slice."""
    starts, ends, bounds = s.words(BETWEEN)
    w = s.span_hash(starts, ends, lower=True)
    doc = owners(bounds)
    docs, keys = [doc], [mix(w)]
    for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xBF58476D1CE4E5B9)):
        same = doc[gap:] == doc[:-gap]
        docs.append(doc[gap:][same])
        keys.append(mix(w[:-gap][same] * U(salt) + w[gap:][same]))
    return np.concatenate(docs), (np.concatenate(keys) >> U(64 - BITS)).astype(np.int64)


class FTRL:
    """Per-coordinate FTRL-proximal with binary features."""

    def __init__(self):
        self.z, self.n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        self.bias, self.bias_n = 0.0, 0.0

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(self.bias + w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g
        self.bias_n += g * g
        self.bias -= ALPHA / (BETA + np.sqrt(self.bias_n)) * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray, float]:
        at = np.flatnonzero(np.abs(self.z) > L1)
        return at, self.weights(at).astype(np.float32), float(self.bias)


def list_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, text) to (id, label, text's hash, distinct features)."""
    for batch in batches:
        for s in slices(batch.column(3)):
            doc, key = features(s)
            order = np.argsort(doc, kind="stable")
            at = np.searchsorted(doc[order], np.arange(s.n + 1))
            sets = [np.unique(key[order[a:b]]).astype(np.int32) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(s.first, s.n) for c in range(3)), pa.array(sets, pa.list_(pa.int32()))], ["id", "label", "tie", "features"])


def score_batches(model: tuple[np.ndarray, np.ndarray, float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, value, bias = model
    table = np.zeros(1 << BITS, np.float32)
    table[at] = value
    for batch in batches:
        for s in slices(batch.column(1)):
            doc, key = features(s)
            counts = np.flatnonzero(table[key])
            pairs = np.unique(doc[counts].astype(np.int64) << BITS | key[counts])  # a feature counts once in a text
            total = np.bincount(pairs >> BITS, table[pairs & ((1 << BITS) - 1)], s.n)[: s.n] + bias
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], ["doc_id", "score"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, max_features: int = 6_000_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias), from at most ``max_rows`` ids that have at most ``max_features`` features together."""
    scratch = common.Scratch(docs.sparkSession, "toxic")
    some = labels.select(F.col(id_col).cast("long").alias("wanted"), (F.col(label_col).cast("int") > 0).cast("int").alias("label")).dropna().groupBy("wanted").agg(F.max("label").alias("label"))
    some = scratch.put(some.orderBy(F.xxhash64("wanted"), "wanted").limit(max_rows), "labels")  # bounded, so it can be broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    rows = texts.join(F.broadcast(some), F.col("id") == F.col("wanted")).select("id", "label", F.xxhash64("text").alias("tie"), "text")
    each = common.mapped(rows, list_features, "id long, label int, tie long, features array<int>")
    each = scratch.put(each.groupBy("id").agg(F.min_by(F.struct("label", "features"), "tie").alias("one")).select("id", F.xxhash64("id").alias("place"), "one.label", "one.features"), "features")
    sizes = sorted((r["place"], r["id"], r["n"]) for r in each.select("place", "id", F.size("features").alias("n")).collect())  # max_rows at most
    within = int(np.searchsorted(np.cumsum([n for _, _, n in sizes]), max_features, "right"))
    learned = F.broadcast(docs.sparkSession.createDataFrame([(i,) for _, i, _ in sizes[:within]], "chosen long"))
    sample = each.join(learned, F.col("id") == F.col("chosen")).select("place", "id", "label", "features").toArrow().combine_chunks()
    learner = FTRL()
    if not sample.num_rows:
        return learner.sparse()
    lists = sample.column("features").combine_chunks()
    flat, off = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    label = sample.column("label").to_numpy()
    order = np.lexsort([sample.column("id").to_numpy(), sample.column("place").to_numpy()])
    for _ in range(EPOCHS):
        for k in order:
            learner.learn(flat[off[k] : off[k + 1]], int(label[k]))
    return learner.sparse()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = common.mapped(rows, lambda batches: score_batches(model, batches), "doc_id long, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
