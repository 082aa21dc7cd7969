"""URL filtering: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

DataFrame operations only. The list is put into a blocked Bloom filter, sized
by the list and bounded (:mod:`sparkmill.llm.bloom`), and broadcast; a page
whose canonical URL misses it is surely not listed and never moves. Possible
hits go to an exact hash join with the list, which removes the false positives.

Defined results: a null URL or one without ``://`` has an empty host and path,
fits no rule, has no canonical form and is allowed; URLs of any length are read
whole; repeated rows each get their verdict; an empty table gives an empty
table; an empty list allows all that no rule blocks, and its null, repeated or
malformed entries list nothing more; of rules that fit the longest (host and
path together, then in text order) wins; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmill.llm import bloom
from sparkmill.llm.common import Scratch, ascii_lower

Rule = tuple[str, str, str]  # verdict, host, path

TRACKING = r"(?<=[?&])(?:utm_[^&]*|ref=[^&]*|fbclid=[^&]*|gclid=[^&]*)(?:&|$)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without closing slashes, query without tracking fields; null without ``://``.

    The scheme and the fragment go; case matters outside the host.
    """
    query = F.regexp_replace(F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1), TRACKING, "")
    text = F.concat(F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), r"/+$", ""), F.regexp_replace(query, r"[?&]+$", ""))
    return F.when(F.instr(url, "://") > 0, text)


def _ordered(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r[1] + r[2]))


def rule_columns(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls. Rules are code, a bounded list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in reversed(_ordered(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", filter_bits: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every page; ``listed`` is a table of URLs to block."""
    scratch = Scratch(pages.sparkSession, "urls")
    names = scratch.put(listed.select(canonical(F.col(listed_col)).alias("__listed")).where("__listed IS NOT NULL").distinct(), "listed")
    filter_bits = bloom.bits_for(names.count()) if filter_bits is None else bloom.check_bits(filter_bits)
    blocks = scratch.put(bloom.build(names.withColumn("__hash", F.xxhash64("__listed")), "__hash", filter_bits), "blocks")
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("__url"))
    rows = bloom.probe(rows, F.xxhash64("__url"), blocks, filter_bits, "__maybe")
    rows = rows.withColumn("__maybe", F.col("__maybe") & F.col("__url").isNotNull())
    missed = rows.where("NOT __maybe").withColumn("listed", F.lit(False))
    hits = rows.where("__maybe").join(names, F.col("__url") == F.col("__listed"), "left").withColumn("listed", F.col("__listed").isNotNull())
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    keep = ["page_id", "host", "path", "listed"]
    return missed.select(*keep).unionByName(hits.select(*keep)).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed",
    )
