"""Sums that do not depend on the order of addition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_sum(value: Column, scale: int = 4) -> Column:
    """The sum of doubles as decimals of ``scale`` places, back as double: equal on any partitioning."""
    return F.sum(value.cast(f"decimal(18,{scale})")).cast("double")
