"""Exact deduplication by two-pass Bloom filtering (DataFrame operations only).

The first pass hashes each text and counts hits of Bloom bits; bits hit twice
form a broadcast filter. In the second pass a row whose bits are not in it is
unique and passes straight through without a shuffle; only the possibly
repeated rows are shuffled and resolved exactly on SHA-256.

The filter has 16 bits for each row, so that few unique rows move at any size.
Beyond ``filter_bits`` (2^26 by default: 4 million rows) the digests are written
by slices of the hash, and each slice has a filter of its own, one broadcast at
a time: equal texts are always in one slice.

Defined results:

* null text counts as empty; texts are equal when they are identical after
  lower-casing A-Z only; the row with the largest id of equal texts stays;
* a null id is smaller than any other; a group with null ids only keeps all its
  rows (they cannot be told apart) and its keep id is null;
* rows that repeat the id that stays all stay; each counts in the group size;
* texts of any length are hashed whole; an empty table gives an empty table;
* other columns are ignored by :func:`annotate` and passed through by
  :func:`drop_copies`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm import bloom
from sparkmill.llm.common import Scratch, ascii_lower


def digest(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the normalised text in UTF-8."""
    return F.sha2(F.coalesce(ascii_lower(text), F.lit("")).cast("binary"), 256)


def _flagged(scratch: Scratch, digests: DataFrame, filter_bits: int) -> DataFrame:
    """A written table (id, sha, maybe): maybe is false where no other row has the digest."""
    h = F.xxhash64("sha")
    digests = scratch.put(digests, "digests")
    values = digests.count()
    slices = bloom.slices_for(values, filter_bits)
    if slices > 1:
        whole, digests = digests, scratch.put(digests.withColumn("slice", F.pmod(F.xxhash64("sha", F.lit("slice")), F.lit(slices)).cast("int")), "sliced", by="slice")
        scratch.free(whole)
    bits = min(filter_bits, bloom.bits_for(-(-values // slices)))
    path = scratch.path("flagged")
    for k in range(slices):
        part = digests.where(F.col("slice") == k).drop("slice") if slices > 1 else digests
        blocks = scratch.put(bloom.build_repeated(part.withColumn("hash", h), "hash", bits), "blocks")
        scratch.append(bloom.probe(part, h, blocks, bits, "maybe"), path)
        scratch.free(blocks)
    return scratch.read(path, digests.select("id", "sha").withColumn("maybe", F.lit(True)).schema)


def _groups(scratch: Scratch, flagged: DataFrame) -> DataFrame:
    """The groups of two or more equal texts."""
    groups = flagged.where("maybe").groupBy(F.col("sha").alias("group")).agg(F.max("id").alias("keep"), F.count("*").alias("size")).where("size > 1")
    return scratch.put(groups, "groups")


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = bloom.MAX_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    bloom.check_bits(filter_bits)
    scratch = Scratch(docs.sparkSession, "exact")
    flagged = _flagged(scratch, docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("sha")), filter_bits)
    groups = _groups(scratch, flagged)

    def shape(df: DataFrame, keep: Column, size: Column) -> DataFrame:
        return df.select(F.col("id").alias("doc_id"), keep.alias("keep_id"), size.alias("group_size"), F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"))

    alone = shape(flagged.where("NOT maybe"), F.col("id"), F.lit(1).cast("long"))
    moved = flagged.where("maybe").join(groups, F.col("sha") == F.col("group"), "left")
    lone = F.col("group").isNull()
    return alone.unionByName(shape(moved, F.when(lone, F.col("id")).otherwise(F.col("keep")), F.coalesce("size", F.lit(1).cast("long"))))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = bloom.MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns. Only rows whose digest a dropped row may have are shuffled."""
    bloom.check_bits(filter_bits)
    scratch = Scratch(docs.sparkSession, "exact-rows")
    flagged = _flagged(scratch, docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("sha")), filter_bits)
    groups = _groups(scratch, flagged)
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), digest(F.col(text_col)).alias("sha"))
    rows = bloom.probe_keys(whole, F.col("sha"), groups, "group", scratch, "maybe")
    moved = rows.where("maybe").join(groups, F.col("sha") == F.col("group"), "left")
    stays = moved.where(F.col("group").isNull() | F.col("id").eqNullSafe(F.col("keep")))
    return rows.where("NOT maybe").select("row.*").unionByName(stays.select("row.*"))
