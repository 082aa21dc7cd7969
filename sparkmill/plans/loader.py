"""Structured plans: nested dicts (or their JSON) to DataFrames.

Nodes: read, filter, project, join, cross, aggregate (with ``having``), distinct, window, sort, fetch, set. Expressions:
``{"col": name}``, ``{"lit": value}``, ``{"cast": [expr, type]}``,
``{"case": [[when, then], ...], "else": expr}``, ``{"in": [expr, [values]]}`` and
``{"call": [function, expr, ...]}`` for operators and functions by name.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmill.operators import relational

_BINARY: dict[str, Callable[[Column, Column], Column]] = {
    "=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / b, "%": lambda a, b: a % b,
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "is not distinct from": lambda a, b: a.eqNullSafe(b),
}
_AGGREGATES: dict[str, Callable[[Column], Column]] = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": F.count_distinct, "first": F.first}
_RANKS: dict[str, Callable[[], Column]] = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank, "cume_dist": F.cume_dist}


def expression(e) -> Column:
    """A Column for an expression node."""
    if not isinstance(e, dict):
        return F.lit(e)
    if "col" in e:
        return F.col(e["col"])
    if "lit" in e:
        return F.lit(e["lit"])
    if "cast" in e:
        return expression(e["cast"][0]).cast(e["cast"][1])
    if "in" in e:
        return expression(e["in"][0]).isin(*e["in"][1])
    if "case" in e:
        (w, t), *rest = e["case"]
        out = F.when(expression(w), expression(t))
        for w, t in rest:
            out = out.when(expression(w), expression(t))
        return out.otherwise(expression(e["else"])) if "else" in e else out
    name, *args = e["call"]
    columns = [expression(a) for a in args]
    if name in _BINARY:
        return reduce(_BINARY[name], columns)
    if name == "not":
        return ~columns[0]
    if name == "is null":
        return columns[0].isNull()
    if name == "like":
        return columns[0].like(args[1]["lit"] if isinstance(args[1], dict) else args[1])
    return F.call_function(name, *columns)


def _aggregate(a: dict) -> Column:
    return F.count(F.lit(1)) if a["fn"] == "count_star" else _AGGREGATES[a["fn"]](expression(a["arg"]))


def _sort_keys(keys: list[dict]) -> list[Column]:
    return [relational.ordering(k["col"], k.get("desc", False), k.get("nulls_first", False)) for k in keys]


def load(plan: dict | str, tables: Callable[[str], DataFrame]) -> DataFrame:
    """Build the DataFrame of a plan; ``tables`` finds a table by name."""
    if isinstance(plan, str):
        plan = json.loads(plan)
    kind = plan["op"]
    under = load(plan["input"], tables) if "input" in plan else None
    if kind == "read":
        df = tables(plan["table"])
        return df.select(*plan["columns"]) if "columns" in plan else df
    if kind == "filter":
        return relational.filter_all(under, *[expression(p) for p in plan["predicates"]])
    if kind == "project":
        return relational.project(under, *[expression(e).alias(n) for n, e in plan["columns"].items()])
    if kind == "join":
        left, right = load(plan["left"], tables), load(plan["right"], tables)
        return relational.join(left, right, expression(plan["condition"]), plan.get("how", "inner"))
    if kind == "aggregate":
        made = relational.aggregate(under, plan.get("keys", []), [_aggregate(a).alias(n) for n, a in plan.get("aggregates", {}).items()])
        return relational.filter_all(made, *[expression(p) for p in plan.get("having", [])])
    if kind == "cross":
        return load(plan["left"], tables).crossJoin(load(plan["right"], tables))
    if kind == "distinct":
        return relational.distinct_on(under, plan["keys"], _sort_keys(plan["order"])) if "keys" in plan else under.distinct()
    if kind == "window":
        over = Window.partitionBy(*plan.get("keys", [])).orderBy(*_sort_keys(plan.get("order", [])))
        if "rows" in plan:
            over = over.rowsBetween(*[Window.unboundedPreceding if b == "first" else Window.unboundedFollowing if b == "last" else b for b in plan["rows"]])
        return under.select("*", *[(_RANKS[a["fn"]]() if a["fn"] in _RANKS else _aggregate(a)).over(over).alias(n) for n, a in plan["columns"].items()])
    if kind == "sort":
        return under.orderBy(*_sort_keys(plan["keys"]))
    if kind == "fetch":
        out = under.offset(plan["offset"]) if plan.get("offset") else under
        return out.limit(plan["count"])
    if kind == "set":
        left, right = load(plan["left"], tables), load(plan["right"], tables)
        return {"union_all": left.unionByName, "union": lambda r: left.unionByName(r).distinct(), "intersect": left.intersect, "intersect_all": left.intersectAll, "except": left.subtract, "except_all": left.exceptAll}[plan["kind"]](right)
    raise ValueError(f"unknown plan node {kind!r}")
