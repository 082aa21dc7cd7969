"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

A text is read in windows of ``WINDOW`` bytes. In either direction a GRU of
``HIDDEN`` units runs over a window; both states label every position with
probabilities of the languages, and a document's probabilities are the mean
over all its positions. Training is backpropagation through time with Adam on a
bounded sample: at most ``max_docs`` labelled texts, shared between all
languages of the table, ``WINDOWS_PER_DOC`` windows of each from anywhere in the
text. The weights (about 50 KB) travel with
the function.

Defined results: null text, or text without a letter, is ``und`` with score 0;
without any labelled document every text is ``und``; texts of any length are
read whole; a null id is not held out; repeated rows give a row each; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm import common
from sparkmill.llm.textkit import per_doc, slices

WINDOW, HIDDEN, WINDOWS_PER_DOC, BLOCK = 64, 8, 8, 2048
STEPS, BATCH, RATE = 250, 256, 0.02
SPARE = 30
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights by name: for direction d, ``x{d}`` (byte to the three gates) and ``u{d}`` (state to gates); ``v``, ``b`` (states to labels)."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        h = HIDDEN
        self.labels = labels
        self.w = {"x0": draw(256, 3 * h), "x1": draw(256, 3 * h), "u0": draw(h, 3 * h), "u1": draw(h, 3 * h), "v": draw(2 * h, len(labels)), "b": np.zeros(len(labels), np.float32)}

    def direction(self, d: int, windows: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (position, window, unit) of one direction; padding follows the text, so the backward pass starts there."""
        h, (n, length) = HIDDEN, windows.shape
        x, u = self.w[f"x{d}"], self.w[f"u{d}"]
        state, out = np.zeros((n, h), np.float32), np.empty((length, n, h), np.float32)
        for t in range(length) if d == 0 else range(length - 1, -1, -1):
            gates, rec = x[windows[:, t]], state @ u
            zr = sigmoid(gates[:, : 2 * h] + rec[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            new = np.tanh(gates[:, 2 * h :] + r * rec[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, z, r, new, rec[:, 2 * h :]))
            state = new + z * (state - new)
            out[t] = state
        return out

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """Label probabilities (position, window, label)."""
        both = np.concatenate([self.direction(0, windows), self.direction(1, windows)], axis=2)
        return self._softmax(both @ self.w["v"] + self.w["b"])

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def gradients(self, windows: np.ndarray, mask: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over the positions under ``mask``."""
        h, keeps = HIDDEN, ([], [])
        states = [self.direction(d, windows, keeps[d]) for d in (0, 1)]
        both = np.concatenate(states, axis=2)
        slope = self._softmax(both @ self.w["v"] + self.w["b"])
        slope[:, np.arange(len(target)), target] -= 1
        slope *= (mask.T / mask.sum())[:, :, None]
        flat = slope.reshape(-1, slope.shape[2])
        g = {"v": both.reshape(-1, 2 * h).T @ flat, "b": flat.sum(0)}
        back = slope @ self.w["v"].T
        for d in (0, 1):
            u, carry = self.w[f"u{d}"], np.zeros((len(target), h), np.float32)
            seen, slopes, gu = [], [], np.zeros_like(u)
            for t, before, z, r, new, rec in reversed(keeps[d]):
                dh = back[t, :, d * h : (d + 1) * h] + carry
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (before - new) * z * (1 - z)
                dr = dnew * rec * r * (1 - r)
                gates = np.concatenate([dz, dr, dnew], axis=1)
                into = np.concatenate([dz, dr, dnew * r], axis=1)
                seen.append(windows[:, t])
                slopes.append(gates)
                gu += before.T @ into
                carry = dh * z + into @ u.T
            bytes_, parts = np.concatenate(seen), np.concatenate(slopes)
            gx = np.stack([np.bincount(bytes_, parts[:, k], 256) for k in range(3 * h)], axis=1).astype(np.float32)
            g[f"x{d}"], g[f"u{d}"] = gx, gu
        return g

    def fit(self, windows: np.ndarray, mask: np.ndarray, target: np.ndarray, steps: int = STEPS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(target), min(BATCH, len(target)))
            rate = RATE * (1 - 0.9 * step / steps)
            for k, g in self.gradients(windows[pick], mask[pick], target[pick]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                self.w[k] = self.w[k] - (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)


def windows_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, length of each, where each document's windows begin)."""
    count = -(-np.diff(off) // WINDOW)
    bounds = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(count)), count)
    begin = off[doc] + WINDOW * (np.arange(bounds[-1]) - bounds[doc])
    length = np.minimum(off[doc + 1] - begin, WINDOW)
    at = begin[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0) if len(data) else np.zeros((0, WINDOW), np.uint8), length, bounds


def predict(net: Network, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (doc_id, guess, sure)."""
    for batch in batches:
        for s in slices(batch.column(1)):
            windows, length, bounds = windows_of(s.data, s.off)
            total = np.zeros((len(windows), len(net.labels)), np.float64)
            for a in range(0, len(windows), BLOCK):
                part = windows[a : a + BLOCK]
                inside = (np.arange(WINDOW)[:, None] < length[a : a + BLOCK]).astype(np.float32)
                total[a : a + BLOCK] = (net.positions(part) * inside[:, :, None]).sum(axis=0)
            pooled = np.stack([per_doc(total[:, k].copy(), bounds) for k in range(len(net.labels))], axis=1)
            pooled /= np.maximum(pooled.sum(axis=1, keepdims=True), 1e-12)
            best = pooled.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.first, s.n), pa.array([net.labels[k] for k in best], pa.string()), pa.array(np.minimum(pooled[np.arange(s.n), best], 1.0))], ["doc_id", "guess", "sure"])


def shares(texts: dict[str, int], max_docs: int) -> dict[str, int]:
    """How many texts each label may give: equal shares of ``max_docs``, one at least; what a rare label leaves goes to the others."""
    out, left = {}, max_docs
    for k, (label, n) in enumerate(sorted(texts.items(), key=lambda x: (x[1], x[0]))):
        out[label] = max(left // (len(texts) - k), 1)
        left -= min(n, out[label])
    return out


def train(labelled: DataFrame, max_docs: int = 1500, text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Fit on at most ``max_docs`` texts (but one of every language), shared between the languages; equal texts count once.

    Every language of a text that is not empty is a label. Its share is taken in the order of a hash of the text.
    """
    text = F.col(text_col)
    cut = [F.substring(text, F.pmod(F.xxhash64(text, F.lit(j)), F.greatest(F.length(text) - WINDOW, F.lit(1))).cast("int") + 1, F.lit(WINDOW)) for j in range(WINDOWS_PER_DOC)]
    rows = labelled.where(text.isNotNull() & F.col(lang_col).isNotNull() & (text != "")).select(F.xxhash64(text).alias("place"), F.col(lang_col).alias("lang"), *(c.alias(f"w{j}") for j, c in enumerate(cut)))
    texts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("place").alias("n")).collect()}  # one row per language
    labels = sorted(texts)
    if not labels:
        return None
    share = shares(texts, max_docs)
    # Hashes that cannot be among a language's smallest go first: twice its share, and SPARE so that none is left without a text, are expected to stay.
    expected = {x: 2 * share[x] + SPARE for x in labels}
    bound = [(x, (1 << 63) - 1 if n <= expected[x] else -(1 << 63) + (expected[x] << 64) // n) for x, n in texts.items()]
    bounds = F.broadcast(labelled.sparkSession.createDataFrame(bound, "__lang string, __bound long"))
    near = rows.join(bounds, (F.col("lang") == F.col("__lang")) & (F.col("place") <= F.col("__bound"))).drop("__lang", "__bound")
    sample, taken = [], dict.fromkeys(labels, 0)
    for r in sorted(near.dropDuplicates(["place", "lang"]).collect(), key=lambda r: (r["place"], r["lang"])):  # about 2 * max_docs rows of 8 short windows
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= share[r["lang"]]:
            sample.append(r)
    net = Network(labels)
    texts = [(r[f"w{j}"].encode()[:WINDOW], labels.index(r["lang"])) for r in sample for j in range(WINDOWS_PER_DOC) if r[f"w{j}"]]
    data = np.frombuffer(b"".join(t.ljust(WINDOW, b"\0") for t, _ in texts), np.uint8).reshape(-1, WINDOW)
    mask = (np.arange(WINDOW) < np.array([len(t) for t, _ in texts])[:, None]).astype(np.float32)
    if len(labels) > 1:
        net.fit(data, mask, np.array([k for _, k in texts]))
    return net


def identify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, lang_pred, score."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(F.regexp_like(text, F.lit(r"\p{L}")), text).alias("text"))
    if net is None:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    rows = rows.withColumn("lettered", F.col("text").isNotNull())

    def run(batches):
        for batch in batches:
            flags = batch.column(2)
            done = 0
            for out in predict(net, iter([batch])):
                yield pa.RecordBatch.from_arrays([*out.columns, flags.slice(done, out.num_rows)], ["doc_id", "guess", "sure", "lettered"])
                done += out.num_rows

    out = common.mapped(rows, run, "doc_id long, guess string, sure double, lettered boolean")
    return out.select("doc_id", F.when(F.col("lettered"), F.col("guess")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col("lettered"), F.col("sure")).otherwise(F.lit(0.0)).alias("score"))


def fold(id_col: Column, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds
