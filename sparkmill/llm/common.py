"""Scratch tables and small column helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Functions travel to the executors by value, so these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules["sparkmill"])

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session without that setting on this machine alone (a local test) gets a folder of its own; on a cluster
    that would lose rows without an error, so it is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="sparkmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables of one operator call, written once so that later steps reread them instead of recomputing."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.tables: list[DataFrame] = []
        _made.append((spark, self.base))

    def path(self, name: str) -> str:
        """A new place for a table."""
        self.count += 1
        return f"{self.base}/{self.count:03d}-{name}"

    def read(self, path: str, schema: StructType) -> DataFrame:
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        self.tables.append(out)
        return out

    def put(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write ``df`` as Parquet, in folders by a column if asked for, and return the table read back (its lineage is the files)."""
        path = self.path(name)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        return self.read(path, df.schema)

    def append(self, df: DataFrame, path: str) -> None:
        df.write.mode("append").parquet(path)

    def free(self, df: DataFrame) -> None:
        """Delete a table of :meth:`put` that nothing reads any more."""
        self.tables = [t for t in self.tables if t is not df]
        drop_table(self.spark, df._scratch_path)

    def keep_only(self, *kept: DataFrame) -> None:
        """Delete all tables but those that the result still reads."""
        for df in self.tables:
            if not any(df is k for k in kept):
                self.free(df)


@atexit.register
def _clean() -> None:
    for spark, base in _made:
        try:
            drop_table(spark, base)
        except Exception:  # noqa: BLE001 - the session is gone already
            return


#: Bytes of an Arrow batch: what goes to a Python worker at once, but for a single longer row.
BATCH_BYTES = 8 << 20


def mapped(df: DataFrame, of_batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` in small batches; at a task's end its worker, which later tasks use again, gives freed memory back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    df.sparkSession.conf.set(name, str(BATCH_BYTES))

    def run(batches):
        try:
            yield from of_batches(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # another C library
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(run, schema)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, UPPER, UPPER.lower())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def drop_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the ids in ``gone`` (one long column ``doc_id``); rows with a null id stay.

    A Bloom filter of the ids is broadcast: rows that miss it pass straight
    through, and only possible hits are shuffled for the exact test. The columns
    of ``docs`` are passed on whatever their names.
    """
    from sparkmill.llm import bloom

    scratch = Scratch(docs.sparkSession, "drop")
    gone = scratch.put(gone.select(F.col("doc_id").alias("gone")).where("gone IS NOT NULL").distinct(), "ids")
    whole = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    rows = bloom.probe_keys(whole, F.col("id"), gone, "gone", scratch, "maybe")
    stays = rows.where("maybe").join(gone, F.col("id") == F.col("gone"), "left_anti")
    return rows.where("NOT maybe").select("row.*").unionByName(stays.select("row.*"))
