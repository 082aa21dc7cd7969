"""Joins beyond ``DataFrame.join``: mark, theta, quantified, as-of, range and positional."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.sources import scratch


def mark_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, mark: str = "mark") -> DataFrame:
    """``left`` with the value of ``left_key IN (right_key)``, three-valued as in SQL.

    The distinct keys of the right side and its null and row counts (one row)
    decide the mark, so that both sides move at most once, by key.
    """
    keys = right.select(F.col(right_key).alias("__key")).where("__key IS NOT NULL").distinct().withColumn("__hit", F.lit(True))
    facts = right.agg(F.count("*").alias("__rows"), F.count(right_key).alias("__known"))
    joined = left.join(keys, F.col(left_key) == F.col("__key"), "left").crossJoin(F.broadcast(facts))  # one row
    unsure = F.col(left_key).isNull() | (F.col("__rows") > F.col("__known"))
    found = F.when(F.col("__rows") == 0, False).when(F.col("__hit"), True).when(unsure, F.lit(None).cast("boolean")).otherwise(False)
    return joined.withColumn(mark, found).select(*left.columns, mark)


def not_in(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The rows for which ``left_key NOT IN (right_key)`` is true: null-aware, and by shuffle.

    Spark's own null-aware anti join broadcasts the right side whatever its size.
    """
    return mark_join(left, right, left_key, right_key, "__mark").where("NOT __mark").drop("__mark")


_COMPARE = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def quantified(left: DataFrame, right: DataFrame, left_key: str, op: str, kind: str, right_key: str, mark: str = "mark") -> DataFrame:
    """``left`` with the value of ``left_key op ANY (right_key)`` or ``ALL``, three-valued as in SQL.

    The least and greatest key of the right side decide it (``= ANY`` and
    ``<> ALL`` are the mark join), so that no pairs are formed and one row is broadcast.
    """
    kind = kind.lower()
    if (op, kind) in (("=", "any"), ("<>", "all")):
        marked = mark_join(left, right, left_key, right_key, mark)
        return marked if kind == "any" else marked.withColumn(mark, ~F.col(mark))
    facts = right.agg(F.count("*").alias("__rows"), F.count(right_key).alias("__known"), F.min(right_key).alias("__low"), F.max(right_key).alias("__high"))
    ends = [_COMPARE[op](F.col(left_key), F.col(c)) for c in ("__low", "__high")]
    some = reduce(lambda a, b: a | b if kind == "any" else a & b, ends)  # with the ends it holds for one, or for all, of the keys
    unsure = F.col(left_key).isNull() | (F.col("__rows") > F.col("__known"))
    null, decided = F.lit(None).cast("boolean"), F.lit(kind == "any")
    found = F.when(F.col("__rows") == 0, ~decided).when((F.col("__known") > 0) & (some == decided), decided).when(unsure, null).otherwise(~decided)
    return left.crossJoin(F.broadcast(facts)).withColumn(mark, found).select(*left.columns, mark)  # one row


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner") -> DataFrame:
    """A join on any condition, of any kind; equalities inside it are still used as keys.

    Without an equality Spark compares all pairs. For EXISTS, ANY or ALL with one
    comparison use :func:`quantified`, for bands :func:`range_join`: they do not.
    """
    return left.join(right, condition, how)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], left_on: str, right_on: str, values: Sequence[str], tie: Sequence[str] = (), width: float | None = None) -> DataFrame:
    """Each left row with ``values`` of the last right row of its key at or before it (left outer).

    Both sides are stacked and the latest right row is carried forward by a
    window over key and time bucket (``width``: seconds of a time, or units of a
    number), so that a hot key is dealt over its buckets. What earlier buckets
    leave comes from one row per key and bucket. Without a width a key is one
    bucket. ``tie`` orders right rows of equal time. Null keys match nothing.
    """
    packed = F.struct(*[F.col(v).alias(v) for v in values])
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*by, right_on]])
    r = right.where(known).select(*by, F.col(right_on).alias("__at"), F.lit(0).alias("__side"), F.struct(*[F.col(t) for t in tie], F.lit(0).alias("__z")).alias("__tie"), packed.alias("__value"))
    row = F.struct(*[F.col(c) for c in left.columns])
    nothing = lambda c: F.lit(None).cast(r.schema[c].dataType).alias(c)
    lrows = left.select(*by, F.col(left_on).alias("__at"), F.lit(1).alias("__side"), nothing("__tie"), nothing("__value"), row.alias("__row"))
    both = lrows.unionByName(r.withColumn("__row", F.lit(None).cast(lrows.schema["__row"].dataType)))
    number = F.col("__at") if r.schema["__at"].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal") else F.unix_micros(F.col("__at").cast("timestamp")) / 1e6
    both = both.withColumn("__bucket", F.floor(number / F.lit(float(width))).cast("long") if width else F.lit(0).cast("long"))
    w = Window.partitionBy(*by, "__bucket").orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("__last", F.last("__value", ignorenulls=True).over(w)).where("__side = 1")
    if width:
        ends = both.groupBy(*by, "__bucket").agg(F.max_by(F.when(F.col("__side") == 0, F.col("__value")), F.when(F.col("__side") == 0, F.struct("__at", "__tie"))).alias("__end"))
        earlier = F.last("__end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
        ends = ends.select(*[F.col(c).alias(f"__k{k}") for k, c in enumerate(by)], F.col("__bucket").alias("__b"), earlier.alias("__before"))
        same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__k{k}") for k, c in enumerate(by)])
        carried = carried.join(ends, same & (F.col("__bucket") == F.col("__b")), "left").withColumn("__last", F.coalesce("__last", "__before"))
    return carried.select("__row.*", *[F.col("__last")[v].alias(v) for v in values])


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs with ``low <= point < high``, by equality on buckets instead of all pairs.

    Buckets of level n are ``width * 2**n`` wide. A band lies in the level where it
    covers three buckets at most, whatever its length; a point looks in one bucket
    of every level that the bands have (64 at most). Bands without a finite length are a level of one bucket.
    """
    length = F.col(high) - F.col(low)
    finite = (F.abs(length) < float("inf")) & ~F.isnan(length) & (F.abs(F.col(low)) < 1e300)
    level = F.when(finite, F.greatest(F.ceil(F.log2(length / F.lit(float(width)))), F.lit(0))).otherwise(F.lit(-1)).cast("int")
    scale = lambda c: F.lit(float(width)) * F.pow(F.lit(2.0), F.col(c))
    bands = right.where(F.col(low) < F.col(high)).withColumn("__level", level)
    first, last = (F.floor(F.col(c) / scale("__level")) for c in (low, high))
    bands = bands.withColumn("__b", F.when(F.col("__level") < 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first.cast("long"), last.cast("long")))).withColumn("__b", F.explode("__b"))
    levels = sorted(r[0] for r in right.where(F.col(low) < F.col(high)).select(level).distinct().collect())  # a few numbers
    points = left.withColumn("__l", F.explode(F.array(*[F.lit(n) for n in levels]).cast("array<int>")))
    points = points.withColumn("__bucket", F.when(F.col("__l") < 0, F.lit(0).cast("long")).otherwise(F.floor(F.col(point) / scale("__l")).cast("long")))
    joined = points.join(bands, (F.col("__l") == F.col("__level")) & (F.col("__bucket") == F.col("__b")) & (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)))
    return joined.drop("__bucket", "__b", "__l", "__level")


def positional_join(left: DataFrame, right: DataFrame, left_order: Sequence[str | Column], right_order: Sequence[str | Column]) -> DataFrame:
    """Row n of either side together (full outer), in a stated order.

    Positions come from counts of range partitions, not from one global window.
    """
    l, r = with_position(left, left_order, "__l"), with_position(right, right_order, "__r")  # noqa: E741
    return l.join(r, F.col("__l") == F.col("__r"), "full").drop("__l", "__r")


def with_position(df: DataFrame, order: Sequence[str | Column], name: str, total: str | None = None) -> DataFrame:
    """Number rows from 0 in a total order, range-partitioned: each partition numbers its own and adds the rows before it.

    The numbered partitions are written once, so that positions do not shift when
    an executor is lost and its partition is made again from another sample.
    ``total`` names a further column with the number of rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    inner = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    tagged = scratch.written(ranged.select("*", F.spark_partition_id().alias("__part"), inner.alias("__inner")), "positions")
    counts = tagged.groupBy("__part").agg(F.count("*").alias("__n"))  # one row per partition
    base = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"), F.sum("__n").over(Window.partitionBy()).alias("__all"))
    numbered = tagged.join(F.broadcast(base), F.col("__part") == F.col("__p"))
    return numbered.select(*df.columns, (F.col("__base") + F.col("__inner")).alias(name), *([F.col("__all").alias(total)] if total else []))
