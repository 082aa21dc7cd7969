"""All queries of the engine by name, and their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkmill.queries import frames, texts, tpch
from sparkmill.session import TABLES, Engine

TEXTS = texts.QUERIES | tpch.QUERIES


def _from_text(text: str) -> Callable[[SparkSession, str], DataFrame]:
    used = [t for t in TABLES if re.search(rf"\b{t}\b", text)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).register(sf_dir, used).sql(text)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _from_text(text) for name, text in TEXTS.items()} | frames.QUERIES


def oracle_sql() -> dict[str, str]:
    return TEXTS | frames.ORACLES
