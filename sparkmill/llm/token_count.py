"""Token counts of whole texts, by heap-and-linked-list byte-pair merging (see :mod:`sparkmill.llm.bpe`).

Defined results: null and empty texts have 0 bytes and 0 tokens; texts of any
length are counted whole; a null id and repeated rows give a row each; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmill.llm import common
from sparkmill.llm.bpe import count_batches


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``vocabulary`` is the path of a tokenizer file that every executor has.
    """

    def run(batches):
        return count_batches(vocabulary, batches)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return common.mapped(rows, run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
