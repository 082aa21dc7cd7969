"""Sizes and session settings."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Bytes of each unit; K, M, G and T are binary with and without the i.
UNITS = {"B": 1, "KB": 1 << 10, "KIB": 1 << 10, "MB": 1 << 20, "MIB": 1 << 20, "GB": 1 << 30, "GIB": 1 << 30, "TB": 1 << 40, "TIB": 1 << 40}

#: What results depend on (time zone) and what large inputs need (adaptive plans, skewed joins).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


def parse_size(text: str) -> int:
    """Bytes of a size such as ``1 GB`` or ``1.5KiB``."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]+)\s*", text)
    if not m or m[2].upper() not in UNITS:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * UNITS[m[2].upper()])


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark
