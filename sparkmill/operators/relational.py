"""Filter, projection, aggregation, ordering and limits as functions of DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.operators import joins


def filter_all(df: DataFrame, *predicates: Column | str) -> DataFrame:
    """All predicates hold."""
    for p in predicates:
        df = df.filter(p)
    return df


def project(df: DataFrame, *expressions: Column | str) -> DataFrame:
    return df.select(*expressions)


def join(left: DataFrame, right: DataFrame, on: Column | Sequence[str] | str, how: str = "inner", residual: Column | None = None) -> DataFrame:
    """Equality keys and, for a Column condition, a further residual condition."""
    if residual is not None:
        if not isinstance(on, Column):
            raise ValueError("a residual condition needs a Column condition")
        on = on & residual
    return left.join(right, on, how)


def aggregate(df: DataFrame, keys: Sequence[str | Column], aggs: Sequence[Column]) -> DataFrame:
    """Grouped, or one row without keys; without aggregates the distinct keys."""
    if not aggs:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def ordering(key: str, descending: bool = False, nulls_first: bool = False) -> Column:
    """A sort key; nulls come last unless asked for."""
    c = F.col(key)
    if descending:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


def sort(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    return df.orderBy(*[ordering(k) if isinstance(k, str) else k for k in keys])


def top_n(df: DataFrame, keys: Sequence[str | Column], n: int, offset: int = 0) -> DataFrame:
    """Planned as TakeOrderedAndProject: no full sort."""
    out = sort(df, keys)
    return out.offset(offset).limit(n) if offset else out.limit(n)


def limit_percent(df: DataFrame, keys: Sequence[str | Column], percent: float) -> DataFrame:
    """The first ``percent`` of the rows in a total order, by position: no task holds more than a range of them."""
    order = [ordering(k) if isinstance(k, str) else k for k in keys]
    numbered = joins.with_position(df, order, "__position", "__total")
    return numbered.where(F.col("__position") < F.floor(F.col("__total") * F.lit(percent / 100))).drop("__position", "__total")


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*[ordering(k) if isinstance(k, str) else k for k in order])
    return df.withColumn("__first", F.row_number().over(w)).where("__first = 1").drop("__first")
