"""Preference formatting of pairs of conversations (DataFrame operations only).

The longest common prefix of turns of a chosen and a rejected conversation is
rendered once as the prompt; what follows on either side is its completion.
Every turn is a segment ``<|role|>\\ntext<|end|>\\n``; the text of a part is its
segments in the order of ``turn``. ``masked`` marks segments without loss: the
prompt, and turns of a completion that the assistant did not write.

All steps are by turn: a conversation of any length is never gathered in one
task. :func:`render` joins the segments of a part into one string for callers
whose conversations are of normal length.

Defined results: turns are aligned by their number; two turns are equal when
role and text are; of repeated rows for one turn the smallest (role, text)
counts; null text is empty, a null role is ``unknown``; rows without a
conversation or turn belong to no conversation and give no segment; a pair
whose other side has no turns, or with equal conversations, is all completion,
or all prompt; a pair that names a missing side as null is kept with that side
empty; turns of any length are rendered whole; empty tables give empty tables;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm.common import Scratch


def neighbour_pairs(conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """pair_id, chosen_id, rejected_id: conversations 2k (chosen) and 2k + 1 (rejected), either may be missing."""
    one = F.col(conv_col).cast("long")
    pair = F.shiftright(one, 1)
    ids = conversations.where(one.isNotNull()).select(pair.alias("pair_id"), one.alias("__id"))
    even = F.pmod(F.col("__id"), F.lit(2)) == 0
    return ids.groupBy("pair_id").agg(F.max(F.when(even, F.col("__id"))).alias("chosen_id"), F.max(F.when(~even, F.col("__id"))).alias("rejected_id"))


def preference_segments(conversations: DataFrame, pairs: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """pair_id, chosen_id, rejected_id, prompt_turns, part, turn, role, segment, masked.

    ``pairs`` has pair_id, chosen_id and rejected_id; part is prompt, chosen or rejected.
    """
    scratch = Scratch(conversations.sparkSession, "chat")
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("__conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).where("__conv IS NOT NULL AND turn IS NOT NULL")
    turns = scratch.put(turns.groupBy("__conv", "turn").agg(F.min(F.struct("role", "text")).alias("said")), "turns")
    pairs = scratch.put(pairs.select("pair_id", "chosen_id", "rejected_id"), "pairs")

    def side(name: str) -> DataFrame:
        return turns.join(pairs, F.col("__conv") == F.col(f"{name}_id")).select("pair_id", "chosen_id", "rejected_id", "turn", F.lit(name).alias("part"), "said")

    both = scratch.put(side("chosen").unionByName(side("rejected")), "sides")
    # A turn is common when both sides have it and their (role, text) agree.
    marks = scratch.put(both.groupBy("pair_id", "turn").agg(F.count("*").alias("n"), F.min("said").alias("low"), F.max("said").alias("high")).select("pair_id", "turn", ((F.col("n") < 2) | (F.col("low") != F.col("high"))).alias("differs")), "marks")
    ends = scratch.put(marks.groupBy("pair_id").agg(F.min(F.when(F.col("differs"), F.col("turn"))).alias("split"), F.count("*").alias("turns")), "ends")
    shared = scratch.put(marks.join(ends.withColumnRenamed("pair_id", "__pair"), F.col("pair_id") == F.col("__pair")).where("split IS NULL OR turn < split").groupBy("pair_id").agg(F.count("*").alias("prompt_turns")), "shared")
    ends = scratch.put(ends.join(shared, "pair_id", "left").select(F.col("pair_id").alias("__pair"), "split", F.coalesce("prompt_turns", F.lit(0).cast("long")).alias("prompt_turns")), "splits")
    rows = both.join(ends, F.col("pair_id") == F.col("__pair"))
    common = F.col("split").isNull() | (F.col("turn") < F.col("split"))
    rows = rows.where(~common | (F.col("part") == "chosen"))  # the common prefix is rendered once
    part = F.when(common, F.lit("prompt")).otherwise(F.col("part"))
    segment = F.concat(F.lit("<|"), F.col("said.role"), F.lit("|>\n"), F.col("said.text"), F.lit("<|end|>\n"))
    return rows.select(
        "pair_id", "chosen_id", "rejected_id", "prompt_turns", part.alias("part"), "turn", F.col("said.role").alias("role"),
        segment.alias("segment"), (common | (F.col("said.role") != "assistant")).alias("masked"),
    )


def render(segments: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected: each part as one string (conversations of normal length)."""
    parts = segments.groupBy("pair_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "segment"))), lambda s: s["segment"]), "").alias("text"))
    pick = lambda name: F.coalesce(F.max(F.when(F.col("part") == name, F.col("text"))), F.lit("")).alias(name)
    return parts.groupBy("pair_id").agg(pick("prompt"), pick("chosen"), pick("rejected"))
