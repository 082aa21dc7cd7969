"""Blocked Bloom filters as DataFrames: 64-bit blocks in rows ``(block, bits)``.

A value lives in one block and sets two bits there. A filter has ``BITS_A_VALUE``
bits for each value that it is made for, and never more than ``MAX_BITS``
(1,048,576 rows of 16 bytes), so broadcasting it has a fixed bound. Values that
need more are dealt by hash to several filters, of which one is broadcast at a
time (:func:`slices_for`). A filter that is too small for its values only
answers "maybe" more often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import Scratch

BITS_A_VALUE = 16
LEAST_BITS, MAX_BITS = 1 << 12, 1 << 26


def check_bits(filter_bits: int) -> int:
    """Reject sizes whose broadcast would not be bounded."""
    if not 64 <= filter_bits <= MAX_BITS or filter_bits % 64:
        raise ValueError(f"filter_bits must be a multiple of 64 from 64 to {MAX_BITS}")
    return filter_bits


def bits_for(values: int) -> int:
    """The size of a filter of so many values: a power of two, ``MAX_BITS`` at most."""
    return min(max(LEAST_BITS, 1 << (BITS_A_VALUE * max(values, 1) - 1).bit_length()), MAX_BITS)


def slices_for(values: int, filter_bits: int = MAX_BITS) -> int:
    """How many filters of ``filter_bits`` bits so many values need."""
    return max(1, -(-BITS_A_VALUE * values // filter_bits))


def block_of(value_hash: Column, filter_bits: int) -> Column:
    return F.pmod(value_hash, F.lit(filter_bits // 64))


def bit_positions(value_hash: Column) -> tuple[Column, Column]:
    """Two different positions from 0 to 63."""
    other = F.xxhash64(value_hash, F.lit("bits"))
    first = other.bitwiseAND(F.lit(63))
    step = F.shiftright(other, 6).bitwiseAND(F.lit(31)) * 2 + 1
    return first, (first + step).bitwiseAND(F.lit(63))


def one_bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), position.cast("int"))


def bits_of(value_hash: Column) -> Column:
    a, b = bit_positions(value_hash)
    return one_bit(a).bitwiseOR(one_bit(b))


def build(df: DataFrame, value_hash: str, filter_bits: int) -> DataFrame:
    """The filter of all values of a long hash column."""
    h = F.col(value_hash)
    return df.select(block_of(h, filter_bits).alias("block"), bits_of(h).alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("bits"))


def build_repeated(df: DataFrame, value_hash: str, filter_bits: int) -> DataFrame:
    """The filter of bits that at least two rows set: every repeated value is in it.

    The first pass counts hits of each bit. What moves is (bit, count), summed
    on the map side first, never the rows themselves.
    """
    h = F.col(value_hash)
    a, b = bit_positions(h)
    hits = df.select(block_of(h, filter_bits).alias("block"), F.explode(F.array(a, b)).alias("position"))
    twice = hits.groupBy("block", "position").agg(F.count("*").alias("n")).where("n > 1")
    return twice.groupBy("block").agg(F.bit_or(one_bit(F.col("position"))).alias("bits"))


def probe(df: DataFrame, value_hash: Column, blocks: DataFrame, filter_bits: int, flag: str) -> DataFrame:
    """Add a boolean column: False means surely not in the filter. Rows do not move.

    ``df`` must not have columns of the names used here: callers pack foreign columns in a struct.
    """
    key, bits = "__bloom_block", "__bloom_bits"
    small = F.broadcast(blocks.select(F.col("block").alias(key), F.col("bits").alias(bits)))
    mine = bits_of(value_hash)
    joined = df.withColumn("__bloom_key", block_of(value_hash, filter_bits)).join(small, F.col("__bloom_key") == F.col(key), "left")
    return joined.withColumn(flag, F.coalesce(F.col(bits).bitwiseAND(mine) == mine, F.lit(False))).drop(key, bits, "__bloom_key")


def probe_keys(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: str, scratch: Scratch, flag: str) -> DataFrame:
    """Add a boolean column: False where ``key`` is surely not among the written keys ``wanted``."""
    filter_bits = bits_for(wanted.count())
    blocks = scratch.put(build(wanted.select(F.xxhash64(wanted_key).alias("h")), "h", filter_bits), "bloom")
    return probe(df, F.xxhash64(key), blocks, filter_bits, flag)


def keep_possible(df: DataFrame, key: Column, wanted: DataFrame, wanted_key: str, scratch: Scratch) -> DataFrame:
    """The rows whose ``key`` may be among the written keys ``wanted``; no row moves."""
    return probe_keys(df, key, wanted, wanted_key, scratch, "__maybe").where("__maybe").drop("__maybe")
