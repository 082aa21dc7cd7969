"""The engine: tables by name, SQL text or structured plans to DataFrames."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from sparkmill.config import configure, parse_size
from sparkmill.functions import dialect
from sparkmill.logs import logger
from sparkmill.plans import loader
from sparkmill.sources import scratch

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

_PREPARE = re.compile(r"\s*prepare\s+(\w+)\s+as\s+(.*)", re.IGNORECASE | re.DOTALL)
_EXECUTE = re.compile(r"\s*execute\s+(\w+)\s*(?:\((.*)\))?\s*;?\s*", re.IGNORECASE | re.DOTALL)


class Engine:
    """Queries over registered tables.

    ``cache_size`` is checked and kept for reference: Spark manages its own memory,
    evicts cached blocks one by one and spills, so it reserves nothing. Tables
    belong to the engine: two engines on one session do not see each other's.
    """

    def __init__(self, spark: SparkSession, cache_size: str | None = None):
        self.spark = configure(spark)
        self.cache_size = parse_size(cache_size) if cache_size else None
        self.tables: dict[str, DataFrame] = {}
        self._cached: list[DataFrame] = []
        self._prepared: dict[str, str] = {}
        self.log = logger()

    def register(self, source: str | dict[str, DataFrame], names: Sequence[str] = TABLES) -> Engine:
        """Register Parquet tables of a folder, or given DataFrames."""
        self.tables |= source if isinstance(source, dict) else {n: self.spark.read.parquet(f"{source}/{n}.parquet") for n in names}
        return self

    def _views(self, text: str) -> None:
        """Make this engine's tables that the text names visible to the analyser."""
        words = {w.lower() for w in re.findall(r"\w+", text)}
        for name, df in self.tables.items():
            if name.lower() in words:
                df.createOrReplaceTempView(name)

    def sql(self, text: str, *values, **parameters) -> DataFrame:
        """Run SQL text; ``?`` and ``:name`` parameters are bound, never pasted. ``PREPARE name AS ...`` and ``EXECUTE name(...)`` work too."""
        if m := _PREPARE.fullmatch(text):
            self._prepared[m[1].lower()] = m[2]
            return self.spark.createDataFrame([(m[1],)], "prepared string")
        if m := _EXECUTE.fullmatch(text):
            given = self.spark.sql(f"SELECT {m[2]}").first() if m[2] and m[2].strip() else ()
            return self.sql(self._prepared[m[1].lower()], *given)
        if values and parameters:
            raise ValueError("bind either positional or named parameters")
        self.log.info("query: %s", " ".join(text.split()))
        self._views(text)
        made = self.spark.sql(dialect.rewrite(self._materialise(text)), args=list(values) or parameters or None)
        self.log.debug("columns: %s", made.schema.simpleString())
        return made

    def prepare(self, text: str) -> Callable[..., DataFrame]:
        """A function of the text's ``?`` or ``:name`` parameters."""
        return lambda *values, **parameters: self.sql(text, *values, **parameters)

    def _materialise(self, text: str) -> str:
        """Common tables marked ``MATERIALIZED`` are computed once and read at each use.

        They are kept in memory and on disk until :meth:`uncache`; one that uses earlier common tables is written to the scratch folder.
        """
        for name in dialect.materialised(text):
            head = re.search(rf"\b{name}\s+as\s+materialized\s*\(", text, re.IGNORECASE)
            end = dialect.closing(text, head.end())
            before = text[: head.start()].rstrip().rstrip(",")
            before = "" if re.fullmatch(r"\s*with(\s+recursive)?", before, re.IGNORECASE) else before
            kept = self.spark.sql(dialect.rewrite(f"{before} {text[head.end() : end]}"))
            if before:  # Spark does not find the kept rows of a plan with common tables of its own
                kept = scratch.written(kept, name)
            else:
                self._cached.append(kept.persist(StorageLevel.MEMORY_AND_DISK))
            view = f"{name}_{uuid.uuid4().hex}"
            kept.createOrReplaceTempView(view)
            text = f"{text[: head.start()]}{name} AS (SELECT * FROM {view}{text[end:]}"
        return text

    def from_plan(self, plan: dict | str) -> DataFrame:
        """Run a structured plan (a dict or its JSON)."""
        return loader.load(plan, lambda name: self.tables[name] if name in self.tables else self.spark.table(name))

    def cache(self, table: str, columns: Sequence[str] | None = None, name: str | None = None) -> DataFrame:
        """Keep a table, or some of its columns under ``name``, in memory and on disk for later queries. The table itself stays whole."""
        df = self.tables[table]
        df = (df.select(*columns) if columns else df).persist(StorageLevel.MEMORY_AND_DISK)
        self._cached.append(df)
        if name or not columns:
            self.tables[name or table] = df
        return df

    def uncache(self) -> None:
        for df in self._cached:
            df.unpersist()
        self._cached.clear()

    def explain(self, text: str) -> str:
        """The formatted plan of a query."""
        self._views(text)
        return self.spark.sql("EXPLAIN FORMATTED " + dialect.rewrite(self._materialise(text))).first()[0]

    def copy_out(self, text: str, path: str, kind: str = "parquet", partition_by: Sequence[str] = (), **options) -> None:
        """Write a query's result, in folders by ``partition_by``; nothing is gathered on the driver."""
        self.sql(text).write.mode("overwrite").partitionBy(*partition_by).options(**options).format(kind).save(path)
        self.log.info("copied to %s as %s", path, kind)
