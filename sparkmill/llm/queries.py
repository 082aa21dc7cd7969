"""The registered corpus queries: one thin query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.llm import chat_format, exact_dedup, language, mixing, near_dedup, packing, repetition, token_count, toxicity, url_filter
from sparkmill.llm.common import read
from sparkmill.llm.sql import ORACLE_SQL

#: The rules of the URL contract: (verdict, host, path).
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: No source is repeated more often than this in the mix.
REPETITION_LIMIT = 1.25
#: The block list, by rule and apart from the pages: on these hosts (each with every prefix and domain) the pages of every
#: language whose number is a multiple of LISTED_STEP, below LISTED_NUMBERS, plain or as .html; and one section of an ordinary host.
LISTED_LABELS = ["spam-farm", "cheap-pills", "ads-track", "casino-win", "free-bets", "adult-x"]
LISTED_PREFIXES, LISTED_DOMAINS, LISTED_LANGUAGES, LISTED_FORMS = ["", "m.", "blog."], ["com", "net", "org"], ["en", "de", "fr", "es"], ["", ".html"]
LISTED_STEP, LISTED_NUMBERS = 5, 10_000
LISTED_SECTION = "blog.tionsh.example.com/fr/"


def block_list(spark: SparkSession) -> DataFrame:
    """The list as URLs (column ``url``), about 890,000 whatever the pages are."""
    numbers = spark.range(0, LISTED_NUMBERS, LISTED_STEP)
    pick = lambda values: F.explode(F.array(*map(F.lit, values)))
    rows = numbers.select("id", pick(LISTED_LABELS).alias("label")).select("*", pick(LISTED_PREFIXES).alias("prefix")).select("*", pick(LISTED_DOMAINS).alias("domain"))
    rows = rows.select("*", pick(LISTED_LANGUAGES).alias("lang")).select("*", pick(LISTED_FORMS).alias("form"))
    spam = rows.select(F.concat(F.lit("http://"), "prefix", "label", F.lit(".example."), "domain", F.lit("/"), "lang", F.lit("/"), F.col("id").cast("string"), "form").alias("url"))
    section = spark.range(LISTED_NUMBERS).select("id", pick(LISTED_FORMS).alias("form")).select(F.concat(F.lit("https://" + LISTED_SECTION), F.col("id").cast("string"), "form").alias("url"))
    return spam.unionByName(section)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(language.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    net = language.train(docs.where(~held_out))
    return language.identify(docs, net).withColumn("held_out", held_out)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.coalesce(language.fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return toxicity.score(docs, toxicity.train(docs, labels.where(~held_out))).withColumn("held_out", held_out)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(read(spark, sf_dir, "documents"))


def op7_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return chat_format.preference_segments(conversations, chat_format.neighbour_pairs(conversations))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_filter.judge(pages, block_list(spark), URL_RULES)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(read(spark, sf_dir, "documents"), vocabulary(), repetition_limit=REPETITION_LIMIT).plan()


def vocabulary() -> str:
    """Path of the byte-level BPE file that is installed on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read(spark, sf_dir, "documents"), vocabulary())


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


def op9_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.judge_repetition(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_language": op2_language,
    "op3_toxicity": op3_toxicity,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_token_count": op6_token_count,
    "op7_preference_chat": op7_preference_chat,
    "op8_packing": op8_packing,
    "op9_repetition": op9_repetition,
    "op10_url_filter": op10_url_filter,
}
