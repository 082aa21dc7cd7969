"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept; its result is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.

Defined results of every stage: further columns, whatever their names, are
passed on by all but the last, which ignores them; an empty table gives an empty
table; texts of any length are read whole. What a stage does with nulls, ties and
repeated rows is in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.llm import exact_dedup, language, mixing, near_dedup, packing
from sparkmill.llm.common import Scratch, drop_ids
from sparkmill.llm.queries import REPETITION_LIMIT, vocabulary

#: A document goes when it has no letter, or when the best language is not this far from chance (0) to certain (1).
LEAST_MARGIN = 2 / 15


def least_sure(languages: int) -> float:
    """The least probability of the best of so many languages: 0.35 of four, 0.57 of two; one alone is always certain."""
    return 1 / languages + LEAST_MARGIN * (1 - 1 / languages)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what no language is found for: texts without letters or without a dominant language.

    Null and empty texts go; a null id stays, as what goes is named by id; rows
    that share an id go together, if any of them goes; without any labelled text
    no language is known and all go.
    """
    held_out = F.coalesce(language.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    net = language.train(docs.where(~held_out))
    judged = language.identify(docs, net)
    return drop_ids(docs, judged.where((F.col("lang_pred") == language.UNKNOWN) | (F.col("score") < least_sure(len(net.labels) if net else 1))))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays.

    Null and empty texts are equal; a null id is the smallest, and a group of null
    ids alone stays whole; rows that repeat the id that stays all stay.
    """
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Texts without words are linked with nothing and stay; null ids stay; rows
    that share an id go together.
    """
    judged = Scratch(spark, "near-stage").put(near_dedup.near_duplicates(docs), "judged")
    return drop_ids(docs, judged.where("NOT kept"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Flatten the sources as far as the repetition limit allows, within a budget of all tokens.

    A row comes out as often as its source's weight repeats it, once or more for
    most, not at all for the last blocks of a source whose share shrinks. A null
    source is a source; repeated rows are decided alike.
    """
    return mixing.Mix(docs, vocabulary(), repetition_limit=REPETITION_LIMIT).realise()


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens; a null or empty text is its end token, and repeated rows are packed each."""
    return packing.pack(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack),
]

#: Language identification, mixing and packing are not SQL. The stages and run() are tested against brute force in tests/llm/test_pipeline.py.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
