"""Table sources and sinks: Parquet, delimited text, literals, one row, no row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None, filters: Sequence[Column | str] = ()) -> DataFrame:
    """A Parquet table; columns and filters reach the scan."""
    df = spark.read.parquet(path)
    for f in filters:
        df = df.filter(f)
    return df.select(*columns) if columns is not None else df


def table(spark: SparkSession, sf_dir: str, name: str, columns: Sequence[str] | None = None, filters: Sequence[Column | str] = ()) -> DataFrame:
    return parquet(spark, f"{sf_dir}/{name}.parquet", columns, filters)


def delimited(spark: SparkSession, path: str, schema: StructType | str, sep: str = "|", header: bool = False) -> DataFrame:
    """Delimited text with a known schema (no inference pass)."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header)


def write_delimited(df: DataFrame, path: str, sep: str = "|", header: bool = False) -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=header)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def values(spark: SparkSession, rows: Sequence[tuple], schema: StructType | str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def one_row(spark: SparkSession, *columns: Column) -> DataFrame:
    """The single row of a SELECT without FROM."""
    return spark.range(1).select(*columns)


def empty(df: DataFrame) -> DataFrame:
    """No rows, same columns."""
    return df.where(F.lit(False))
