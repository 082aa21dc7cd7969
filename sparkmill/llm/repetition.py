"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy.

For each length n the characters inside word n-grams that occur twice or more
in the text (their first occurrence included) are measured, as a share of all
characters in words; likewise the characters of lines that repeat an earlier
line. A document is kept when it passes the base rule and no share is above
its limit.

Defined results: a null or empty text has no words, fails the base rule and is
dropped; texts of any length are measured whole; equal lines are equal in every
byte; a null id and repeated rows give a row each; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm import common
from sparkmill.llm.textkit import U, Slice, mix, owners, per_doc, slices

#: Words per n-gram, and the largest share of characters inside repeated ones.
NGRAM_LIMITS = {5: 0.30, 7: 0.28, 10: 0.25}
LINE_LIMIT = 0.30
_ROLL = 0xC2B2AE3D27D4EB4F
_DOC = U(0x9FB21C651E98DF25)
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more, equal to an earlier one) of each key."""
    twice, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    if len(key) > 1:
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        twice[order[1:][same]] = True
        later[order[1:][same]] = True
        twice[order[:-1][same]] = True
    return twice, later


class Measured:
    """Counts of the documents of a slice."""

    def __init__(self, s: Slice, lengths):
        starts, ends, bounds = s.words()
        words = s.span_hash(starts, ends)
        self.n_words = np.diff(bounds)
        doc = owners(bounds).astype(U)
        lead = (s.data & 0xC0) != 0x80
        points = np.concatenate([[0], np.cumsum(lead)])
        size = points[ends] - points[starts]
        self.word_chars = per_doc(size, bounds)
        self.n_symbols = per_doc(SYMBOLS[s.data].astype(np.int64), s.off)
        self._lines(s, points, ends)
        rolled, power = np.zeros(len(words), U), 1
        self.covered, last = {}, 0
        salt = mix((doc + U(1)) * _DOC)
        room = np.repeat(bounds[1:], self.n_words) - np.arange(len(words))  # words from here to the end
        for n in sorted({3, *lengths}):
            for j in range(last, n):  # extend every window by one word
                if j < len(words):
                    rolled[: len(words) - j] += words[j:] * U(power)
                power = power * _ROLL % (1 << 64)
            last = n
            fits = np.flatnonzero(room >= n)
            twice, _ = repeated(mix(rolled[fits] ^ salt[fits]))
            edge = np.zeros(len(words) + 1, np.int64)
            begin = fits[twice]
            edge += np.bincount(begin, minlength=len(edge)) - np.bincount(begin + n, minlength=len(edge))
            inside = np.cumsum(edge[:-1]) > 0
            if n == 3:
                self.n_repeat_words = per_doc(inside.astype(np.int64), bounds)
            if n in lengths:
                self.covered[n] = per_doc(size * inside, bounds)

    def _lines(self, s: Slice, points: np.ndarray, word_ends: np.ndarray) -> None:
        newline = np.flatnonzero(s.data == 10)
        begin = np.unique(np.concatenate([s.off[:-1][np.diff(s.off) > 0], newline + 1]))
        begin = begin[begin < len(s.data)] if len(s.data) else begin[:0]
        doc = np.searchsorted(s.off, begin, "right") - 1
        stop = newline[np.minimum(np.searchsorted(newline, begin), max(len(newline) - 1, 0))] if len(newline) else np.full(len(begin), len(s.data))
        stop = np.minimum(np.where(stop >= begin, stop, len(s.data)), s.off[1:][doc])
        filled = np.searchsorted(word_ends, begin, "right") < np.searchsorted(word_ends, stop, "right")
        begin, stop, doc = begin[filled], stop[filled], doc[filled]
        _, later = repeated(mix(s.span_hash(begin, stop) ^ mix((doc.astype(U) + U(1)) * _DOC)))
        chars = points[stop] - points[begin]
        bounds = np.searchsorted(doc, np.arange(s.n + 1))
        self.n_dup_lines = per_doc(later.astype(np.int64), bounds)
        self.line_chars = per_doc(chars, bounds)
        self.dup_line_chars = per_doc(chars * later, bounds)


def measure(limits: dict[int, float], line_limit: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for batch in batches:
        for s in slices(batch.column(1)):
            m = Measured(s, limits)
            failed = (m.n_words < 50) | (100 * m.n_repeat_words > 50 * m.n_words)
            shares = {n: m.covered[n] / np.maximum(m.word_chars, 1) for n in limits}
            lines = m.dup_line_chars / np.maximum(m.line_chars, 1)
            kept = ~failed & (lines <= line_limit)
            for n, share in shares.items():
                kept &= share <= limits[n]
            columns = [batch.column(0).slice(s.first, s.n), *(pa.array(getattr(m, x).astype(np.int64)) for x in names), pa.array(failed), pa.array(kept), pa.array(lines), *(pa.array(shares[n]) for n in limits)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_failed", "kept", "line_coverage", *(f"coverage_{n}" for n in limits)])


def judge_repetition(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, line_coverage, coverage_<n>."""
    limits = dict(NGRAM_LIMITS if limits is None else limits)

    def run(batches):
        return measure(limits, line_limit, batches)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_coverage double"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.mapped(rows, run, schema + "".join(f", coverage_{n} double" for n in limits))
