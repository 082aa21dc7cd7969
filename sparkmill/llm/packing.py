"""Packing token sequences by column generation for the cutting-stock problem.

Documents are cut into pieces of ``capacity`` tokens and a shorter rest. The
lengths of pieces make a histogram: below ``EXACT`` tokens every length is a bin
of its own, so that many tiny texts fill a sequence without padding; longer ones
are rounded up to ``grain`` tokens. A linear program over patterns (how many
pieces of each bin share a sequence) is solved by column generation: a revised
simplex keeps the master, a knapsack dynamic programme over the dual prices
finds the next pattern. Patterns are rounded down, what is left is packed
first-fit decreasing, and the pieces of each bin, ranked, take the places that
the patterns offer.

The driver holds the histogram and the patterns only, both bounded by the
number of bins. Ranks come from one counter per task and bin, so no group of
pieces meets in one task.

Defined results: a null text is an empty document, which still has its end
token; documents of any length are packed whole; a null id, repeated rows and
ties (equal lengths) are packed like any other row; an empty table gives an
empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.llm import common
from sparkmill.llm.bpe import encoder
from sparkmill.llm.common import Scratch

MAX_COLUMNS = 2000
GAP = 5e-4
EXACT = 64


def rounded(length: int, grain: int, capacity: int) -> int:
    """The bin of a length."""
    return length if length < EXACT else min(-(-length // grain) * grain, capacity)


def best_pattern(value: np.ndarray, most: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: sizes 1..len(value), capacity ``most``; the best value and its counts."""
    n = len(value)
    best, took = np.zeros(most + 1), np.zeros(most + 1, np.int64)
    for c in range(1, most + 1):
        k = min(n, c)
        options = best[c - k : c][::-1] + value[:k]
        i = int(np.argmax(options))
        if options[i] > best[c - 1]:
            best[c], took[c] = options[i], i + 1
        else:
            best[c] = best[c - 1]
    counts, c = np.zeros(n, np.int64), most
    while c > 0:
        if took[c]:
            counts[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[most]), counts


def column_generation(demand: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns by row, how often each) of the relaxed cutting-stock problem.

    ``demand[i]`` items of size ``i + 1``; only sizes with a demand take part.
    """
    sizes = np.flatnonzero(demand) + 1
    m = len(sizes)
    if not m:
        return np.zeros((0, len(demand)), np.int64), np.zeros(0)
    need = demand[sizes - 1].astype(float)
    columns = np.diag(most // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    level = inverse @ need
    least = float(need @ sizes) / most
    value = np.zeros(len(demand))
    for _ in range(MAX_COLUMNS):
        if level.sum() <= max(least, 1e-9) * (1 + GAP):
            break
        price = inverse.sum(axis=0)
        value[:] = 0
        value[sizes - 1] = np.maximum(price, 0)
        worth, counts = best_pattern(value, most)
        if worth <= 1 + 1e-7:
            break
        column = counts[sizes - 1].astype(float)
        step = inverse @ column
        up = step > 1e-9
        if not up.any():
            break
        ratio = np.where(up, level / np.where(up, step, 1), np.inf)
        out = int(np.argmin(ratio))
        amount = ratio[out]
        level -= amount * step
        level[out] = amount
        np.maximum(level, 0, out=level)
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        columns[:, out] = column
    patterns = np.zeros((m, len(demand)), np.int64)
    patterns[:, sizes - 1] = columns.T.round().astype(np.int64)
    return patterns, level


def first_fit(items: np.ndarray, most: int) -> list[dict[int, int]]:
    """First-fit decreasing of a histogram; each bin as {size: count}."""
    bins: list[tuple[int, dict[int, int]]] = []
    for size in range(len(items), 0, -1):
        left = int(items[size - 1])
        for k, (room, held) in enumerate(bins):
            if not left:
                break
            if n := min(left, room // size):
                held[size] = held.get(size, 0) + n
                bins[k] = (room - n * size, held)
                left -= n
        while left:
            n = min(left, most // size)
            bins.append((most - n * size, {size: n}))
            left -= n
    return [held for _, held in bins]


def places(demand: np.ndarray, most: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the ranked items of each size go: rows (size, first rank, end rank, first sequence, items per sequence, first slot)."""
    demand = demand.astype(np.int64)
    patterns, level = column_generation(demand, most)
    plan: list[tuple[dict[int, int], int]] = []
    left = demand.copy()
    for k in np.argsort(-level, kind="stable"):
        used = np.flatnonzero(patterns[k])
        if not len(used):
            continue
        # Never more than what is still there: the bounds of ranks follow.
        times = int(min(np.floor(level[k] + 1e-6), (left[used] // patterns[k][used]).min()))
        if times > 0:
            plan.append(({int(i) + 1: int(patterns[k][i]) for i in used}, times))
            left -= patterns[k] * times
    plan += [(held, 1) for held in first_fit(left, most)]
    rows, rank, sequence = [], np.zeros(len(demand) + 1, np.int64), 0
    for held, times in plan:
        slot = 0
        for size, n in sorted(held.items(), reverse=True):
            rows.append((size, int(rank[size]), int(rank[size]) + n * times, sequence, n, slot))
            rank[size] += n * times
            slot += n
        sequence += times
    return rows


def cut(vocabulary: str, capacity: int, grain: int, end_id: int, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokenise (doc_id, text) and cut; each piece gets the task's own rank in its bin."""
    encode, part = None, TaskContext.get().partitionId()
    rank = [0] * (capacity + 1)
    for batch in batches:
        encode = encode or encoder(vocabulary)
        source, start, length, crc, total, bins, ranks, kept = [], [], [], [], [], [], [], []
        for row, text in enumerate(batch.column(1)):
            ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
            for a in range(0, len(ids), capacity):
                piece = ids[a : a + capacity]
                size = rounded(len(piece), grain, capacity)
                source.append(row)
                start.append(a)
                length.append(len(piece))
                crc.append(zlib.crc32(piece.tobytes()))
                total.append(len(ids))
                bins.append(size)
                ranks.append(rank[size])
                rank[size] += 1
                if with_ids:
                    kept.append(piece.astype(np.int32))
        columns = [batch.column(0).take(pa.array(source, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total, bins, ranks)), pa.array([part] * len(source), pa.int64())]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "rank", "part"]
        if with_ids:
            columns.append(pa.array(kept, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, grain: int = 8, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    scratch = Scratch(docs.sparkSession, "pack")
    spark = docs.sparkSession

    def run(batches):
        return cut(vocabulary, capacity, grain, end_id, with_ids, batches)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bin long, rank long, part long" + ", ids array<int>" * with_ids
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.put(common.mapped(rows, run, schema), "pieces")
    counts = scratch.put(pieces.groupBy("bin", "part").agg(F.count("*").alias("n")), "counts")
    demand = np.zeros(capacity, np.int64)
    for b, n in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most ``capacity`` rows
        demand[b - 1] = n
    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = scratch.put(counts.select(F.col("bin").alias("__bin"), F.col("part").alias("__part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base")), "base")
    table = places(demand, capacity)
    offered = F.broadcast(spark.createDataFrame(table, "__size long, __lo long, __hi long, __first long, __each long, __slot long"))
    ranked = pieces.join(base, (F.col("bin") == F.col("__bin")) & (F.col("part") == F.col("__part"))).withColumn("rank", F.col("rank") + F.col("__base"))
    placed = ranked.join(offered, (F.col("bin") == F.col("__size")) & (F.col("rank") >= F.col("__lo")) & (F.col("rank") < F.col("__hi")))
    nth = F.col("rank") - F.col("__lo")
    placed = placed.withColumn("sequence_id", F.col("__first") + F.expr("(rank - __lo) div __each")).withColumn("__slot", F.col("__slot") + nth % F.col("__each"))
    # A sequence has at most ``capacity`` pieces, so this window is bounded.
    inside = Window.partitionBy("sequence_id").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("offset", F.coalesce(F.sum("length").over(inside), F.lit(0).cast("long")))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)
