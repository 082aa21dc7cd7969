"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

The weight of a source is its token share to the power of an exponent, made to
sum to one. The exponent is bisected until the mix has a target entropy, or
until no source is repeated more often than a limit. A source's budget is its
weight of the total budget: as many whole passes as fit, then blocks of its
documents in a permuted order until the budget is reached, the last block
document by document. A document is never cut, so a source exceeds its budget
by less than one document.

A document's block and place come from hashes of its id; per source the result
is one threshold, so the decision on a row needs no shuffle of documents. There
are as many blocks as the square root of the rows (``LEAST_BLOCKS`` at least):
prefix sums run over the blocks of a source, then over the documents of one
block, so neither grows with the rows themselves.

Tokens are those of a byte-level BPE file, counted once and written with the
hashes of the row (without an end token). Only a caller that names no file gets
the estimate of :func:`default_tokens`.

Up to ``FEW_SOURCES`` sources are held on the driver and their thresholds are
broadcast; beyond, sums over sources are aggregates of a table, of which only
a few numbers reach the driver, and thresholds are joined by shuffle.

Defined results: null source is a source of its own; null and empty texts have
0 tokens and follow their block; texts of any length are counted whole; a null
id is treated as one more id; repeated rows and equal ids are decided alike; an
empty table gives an empty table; other columns are ignored by :meth:`Mix.plan`
and passed on by :meth:`Mix.realise`, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from sparkmill.llm import common
from sparkmill.llm.bpe import encoder
from sparkmill.llm.common import Scratch

LEAST_BLOCKS, FEW_SOURCES = 1024, 10_000
#: Exponents that one pass over many sources tries.
GRID = 32


def default_tokens(text: Column) -> Column:
    """An estimate for when there is no vocabulary: four bytes of text to a token."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


def count(vocabulary: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, becomes its number of tokens."""
    encode = None
    for batch in batches:
        encode = encode or encoder(vocabulary)
        tokens = [len(encode(t.as_py() or "")) for t in batch.column(batch.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(tokens, pa.int64())], [*batch.schema.names[:-1], "tokens"])


def counted(rows: DataFrame, vocabulary: str) -> DataFrame:
    """``rows`` with the tokens of its last column, a text, in place of that column."""

    def run(batches):
        return count(vocabulary, batches)

    return common.mapped(rows, run, StructType(rows.schema.fields[:-1]).add("tokens", LongType()))


def weights(shares: dict[str, float], exponent: float) -> dict[str, float]:
    raw = {s: p**exponent if p > 0 else 0.0 for s, p in shares.items()}
    total = sum(raw.values()) or 1.0
    return {s: x / total for s, x in raw.items()}


def entropy(w: dict[str, float]) -> float:
    return -sum(x * math.log(x) for x in w.values() if x > 0)


def _search(low_enough, low: float, high: float) -> float:
    """The least exponent that is low enough, by bisection; ``low_enough`` takes a list and gives one answer for each."""
    first, last = low_enough([low, high])
    if first or not last:
        return low if first else high
    while high - low > 1e-15 * max(1.0, high):
        steps = [low + (high - low) * k / GRID for k in range(1, GRID)]
        good = [*low_enough(steps), True]
        k = good.index(True)
        before = (low, high)
        low, high = ([low, *steps][k], [*steps, high][k])
        if (low, high) == before:
            break
    return high


def _enough(moments, least_share: float, budget_ratio: float, target_entropy: float | None, repetition_limit: float | None):
    """The test of :func:`_search`, from ``moments(exponents)``: the sums of p**a and of p**a * log(p) for each a."""
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give either target_entropy or repetition_limit")

    def low_enough(exponents: list[float]) -> list[bool]:
        out = []
        for a, (z, logs) in zip(exponents, moments(exponents), strict=True):
            if target_entropy is not None:
                out.append(z <= 0 or math.log(z) - a * logs / z <= target_entropy)
            else:  # below an exponent of 1 the smallest source is repeated most
                out.append(z <= 0 or budget_ratio * least_share ** (a - 1) / z <= repetition_limit * (1 + 1e-12))
        return out

    return low_enough


def exponent_for(shares: dict[str, float], budget_ratio: float = 1.0, target_entropy: float | None = None, repetition_limit: float | None = None) -> float:
    """Bisect the exponent: the one of the target entropy (nats), or the least one that keeps to the limit.

    ``budget_ratio`` is the budget divided by all tokens. Entropy falls, and the
    most repeated source is repeated less, as the exponent grows to 1.
    """
    some = [p for p in shares.values() if p > 0]
    moments = lambda exponents: [(sum(p**a for p in some), sum(p**a * math.log(p) for p in some)) for a in exponents]
    return _search(_enough(moments, min(some, default=1.0), budget_ratio, target_entropy, repetition_limit), 0.0, 16.0 if target_entropy is not None else 1.0)


class Mix:
    """Decisions for the rows of a table of documents; ``vocabulary`` is the path of a tokenizer file that every executor has."""

    def __init__(self, docs: DataFrame, vocabulary: str | None = None, budget: int | None = None, target_entropy: float | None = None, repetition_limit: float | None = None, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", few_sources: int = FEW_SOURCES):
        self.docs, self.seed, self.id, self.source = docs, seed, F.col(id_col), F.col(source_col)
        scratch = Scratch(docs.sparkSession, "mix")
        text = F.col(text_col).cast("string")
        rows = docs.select(self.id.cast("long").alias("doc_id"), self.source.alias("source"), self._key().alias("key"), self._spot().alias("spot"), (default_tokens(text) if vocabulary is None else text).alias("tokens"))
        rows = scratch.put(rows if vocabulary is None else counted(rows, vocabulary), "rows")
        self.blocks = max(LEAST_BLOCKS, 1 << (math.isqrt(rows.count()).bit_length()))
        rows = self.rows = rows.select("*", self._block().alias("block")).select("*", self._order().alias("order"))
        sums = scratch.put(rows.groupBy("key", "block", "order").agg(F.sum("tokens").alias("tokens")), "blocks")
        totals = scratch.put(sums.groupBy("key").agg(F.sum("tokens").alias("tokens")), "sources")
        facts = totals.agg(F.count("*").alias("n"), F.sum("tokens").alias("total"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least")).first()
        self.few, total = facts["n"] <= few_sources, facts["total"] or 0
        self.budget = total if budget is None else budget
        share = F.col("tokens") / F.lit(float(total or 1))
        if self.few:
            held = [r["tokens"] / total for r in totals.where("tokens > 0").collect()]  # few_sources at most
            moments = lambda exponents: [(sum(p**a for p in held), sum(p**a * math.log(p) for p in held)) for a in exponents]
        else:
            def moments(exponents: list[float]) -> list[tuple[float, float]]:
                made = totals.where("tokens > 0").agg(*[c for a in exponents for c in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)))]).first()
                return list(zip(made[::2], made[1::2], strict=True))

        low_enough = _enough(moments, facts["least"] / total if total else 1.0, self.budget / total if total else 1.0, target_entropy, repetition_limit)
        self.exponent = _search(low_enough, 0.0, 16.0 if target_entropy is not None else 1.0) if total else 0.0
        norm = moments([self.exponent])[0][0] if total else 1.0
        weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(self.exponent)) / F.lit(norm)).otherwise(F.lit(0.0))
        wanted = totals.select(F.col("key").alias("source_key"), "tokens", weight.alias("weight")).withColumn("want", F.col("weight") * F.lit(float(self.budget)))
        passes = F.when(F.col("tokens") > 0, F.floor(F.col("want") / F.col("tokens"))).otherwise(F.lit(1)).cast("long")
        wanted = wanted.withColumn("passes", passes).withColumn("rest", F.when(F.col("tokens") > 0, F.col("want") - F.col("passes") * F.col("tokens")).otherwise(F.lit(0.0)))
        wanted = scratch.put(wanted.select("source_key", "weight", "passes", "rest"), "wanted")
        before = F.coalesce(F.sum("tokens").over(Window.partitionBy("key").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = sums.withColumn("before", before).join(self._small(wanted), F.col("key") == F.col("source_key"))
        edge = edge.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("tokens") >= F.col("rest")))
        edge = scratch.put(edge.select("source_key", F.col("block").alias("edge_block"), F.col("order").alias("edge"), (F.col("rest") - F.col("before")).alias("left")), "edge")
        inside = rows.join(self._small(edge), (F.col("key") == F.col("source_key")) & (F.col("block") == F.col("edge_block")))
        inside = inside.groupBy("key", "edge", "left", "spot").agg(F.sum("tokens").alias("tokens"))
        so_far = F.coalesce(F.sum("tokens").over(Window.partitionBy("key").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        last = inside.withColumn("so_far", so_far).where("so_far < left").groupBy("key").agg(F.max("edge").alias("edge"), F.max("spot").alias("edge_spot"))
        self.edges = scratch.put(wanted.join(last, F.col("source_key") == F.col("key"), "left").select("source_key", "weight", "passes", "edge", "edge_spot"), "thresholds")

    def _small(self, df: DataFrame) -> DataFrame:
        """A table of one row per source: broadcast if there are few."""
        return F.broadcast(df) if self.few else df

    def _key(self) -> Column:
        return F.coalesce(F.concat(F.lit("s"), self.source.cast("string")), F.lit("null"))

    def _spot(self) -> Column:
        """The place in the block."""
        return F.xxhash64(self.id.cast("long"), F.lit(self.seed))

    def _block(self) -> Column:
        return F.pmod(F.xxhash64("spot"), F.lit(self.blocks))

    def _order(self) -> Column:
        """The block's place in its source's permutation."""
        return F.xxhash64("key", "block", F.lit(self.seed))

    def _decide(self, rows: DataFrame) -> DataFrame:
        """``rows`` that have key, order and spot, with ``weight`` and ``copies``: how often the mix holds the row, 0 or more."""
        more = (F.col("order") < F.col("edge")) | ((F.col("order") == F.col("edge")) & (F.col("spot") <= F.col("edge_spot")))
        copies = F.col("passes") + F.coalesce(more.cast("long"), F.lit(0))
        return rows.join(self._small(self.edges), F.col("key") == F.col("source_key")).select(*rows.columns, "weight", copies.alias("copies"))

    def plan(self) -> DataFrame:
        """doc_id, source, n_tokens, weight, copies, block_place of every row, from the rows that were counted."""
        return self._decide(self.rows).select("doc_id", "source", F.col("tokens").alias("n_tokens"), "weight", "copies", F.col("order").alias("block_place"))

    def realise(self) -> DataFrame:
        """The rows of the mix, each as often as it is held, with the columns of the documents."""
        rows = self.docs.select(F.struct("*").alias("row"), self._key().alias("key"), self._spot().alias("spot"))
        held = self._decide(rows.select("*", self._block().alias("block")).select("*", self._order().alias("order"))).where("copies > 0")
        return held.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
