import json
import os
import random
import re
import subprocess
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkmill.config import parse_size
from sparkmill.functions.dialect import rewrite
from sparkmill.operators import joins, relational
from sparkmill.queries import registry, tpch
from sparkmill.session import TABLES, Engine

SF = "/root/testdata/sf0.001"
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return ""
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return [tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).values.tolist()]


def final_order(text: str) -> list[str]:
    """The result's columns that the query's last ORDER BY sorts by."""
    m = re.search(r"\border by\s+([^()]*?)(?:\s+limit\s.*)?\s*$", text, re.IGNORECASE | re.DOTALL)
    return [k.split()[0] for k in m[1].split(",")] if m else []


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(rows(got)) == sorted(rows(want))
    if name in registry.TEXTS and (keys := [k for k in final_order(ORACLE[name]) if k in want.columns]):
        assert rows(got[keys]) == rows(want[keys])  # in this order; equal keys may change places


def test_decision_support_queries_have_their_orders():
    assert sum(bool(final_order(t)) for t in tpch.QUERIES.values()) == 18


def test_sizes():
    assert parse_size("1 GB") == 1 << 30 and parse_size("1.5KiB") == 1536 and parse_size("7b") == 7
    with pytest.raises(ValueError):
        parse_size("1 parsec")


def test_dialect_leaves_strings_alone():
    assert rewrite("SELECT '//', a // b, prefix(x, 'prefix(') -- //\n") == "SELECT '//', a  div  b, startswith(x, 'prefix(') -- //"
    assert rewrite("SELECT 'order by a', \"error\"(b)") == "SELECT 'order by a', \"error\"(b)"


def test_dialect_orders_nulls_last():
    assert rewrite("select a from t order by a, b desc nulls first, f(x, y) desc limit 3") == "select a from t order by a NULLS LAST, b desc nulls first, f(x, y) desc NULLS LAST limit 3"
    assert rewrite("select sum(x) over (partition by a order by b rows between 1 preceding and current row) from t order by 1 -- end") == "select sum(x) over (partition by a order by b NULLS LAST rows between 1 preceding and current row) from t order by 1 NULLS LAST -- end"
    assert rewrite("select x from (select y from t order by y) q where z in (1, 2)") == "select x from (select y from t order by y NULLS LAST) q where z in (1, 2)"


def test_error_is_raised_only_where_taken(spark):
    engine = Engine(spark).register({"t": spark.createDataFrame([(1,), (2,)], "a int")})
    assert engine.sql("SELECT CASE WHEN a > 2 THEN error('big') ELSE 'ok' END AS x FROM t").count() == 2
    with pytest.raises(Exception, match="big"):
        engine.sql("SELECT CASE WHEN a > 1 THEN error('big') ELSE 'ok' END AS x FROM t").collect()


def test_parameters(spark):
    engine = Engine(spark).register({"t": spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "a int, s string")})
    assert [r.a for r in engine.sql("SELECT a FROM t WHERE a > ? AND s = ?", 1, "y").collect()] == [2]
    ask = engine.prepare("SELECT a FROM t WHERE a = ? ORDER BY a")
    assert [ask(k).first().a for k in (1, 3)] == [1, 3]
    assert [r.a for r in engine.sql("SELECT a FROM t WHERE s = :s", s="'; --").collect()] == []
    with pytest.raises(ValueError):
        engine.sql("SELECT ? + :b", 1, b=2)


def test_engines_do_not_share_tables(spark):
    one, two = (Engine(spark).register({"t": spark.createDataFrame([(k,)], "a int")}) for k in (1, 2))
    assert one.sql("SELECT a FROM t").first().a == 1 and two.sql("SELECT a FROM t").first().a == 2
    first = one.sql("SELECT a FROM t")
    two.sql("SELECT a FROM t")
    assert first.first().a == 1


def test_cache_leaves_the_table_whole(spark):
    engine = Engine(spark, "1 GB").register({"t": spark.createDataFrame([(1, "x")], "a int, s string")})
    kept = engine.cache("t", ["a"], "narrow")
    assert kept.storageLevel.useMemory and engine.sql("SELECT * FROM t").columns == ["a", "s"] and engine.sql("SELECT * FROM narrow").columns == ["a"]
    engine.uncache()
    assert not kept.storageLevel.useMemory


def test_materialised_tables_are_computed_once(spark):
    engine = Engine(spark).register({"t": spark.range(100).withColumn("k", F.col("id") % 7)})
    text = "WITH s AS MATERIALIZED (SELECT k, sum(id) AS n FROM t GROUP BY k) SELECT x.k, y.n FROM s x JOIN s y ON x.k = y.k WHERE x.n > (SELECT avg(n) FROM s)"
    assert engine.explain(text).count("InMemoryTableScan") >= 3
    two = text.replace("WITH s", "WITH a AS (SELECT k, id FROM t WHERE id >= 0), s").replace("FROM t", "FROM a").replace("FROM a WHERE", "FROM t WHERE")
    rows = [sorted(map(tuple, engine.sql(q).collect())) for q in (text, two, text.replace("MATERIALIZED ", ""))]
    assert rows[0] == rows[1] == rows[2] and rows[0]
    engine.uncache()


def test_log_file_and_level(tmp_path):
    code = "from sparkmill.logs import logger; logger().info('hello'); logger().debug('quiet')"
    env = os.environ | {"SPARKMILL_LOG_DIR": str(tmp_path), "SPARKMILL_LOG_LEVEL": "info", "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    subprocess.run([sys.executable, "-c", code], env=env, check=True)
    assert "hello" in (text := (tmp_path / "sparkmill.log").read_text()) and "quiet" not in text


def test_mark_join_is_three_valued(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    mark = lambda r: {x.k: x.mark for x in joins.mark_join(left, spark.createDataFrame(r, "j int"), "k", "j").collect()}
    assert mark([(1,), (3,)]) == {1: True, 2: False, None: None}
    assert mark([(1,), (None,)]) == {1: True, 2: None, None: None}
    assert mark([]) == {1: False, 2: False, None: False}


def test_not_in_and_quantified_are_three_valued(spark):
    left = spark.createDataFrame([(1,), (5,), (None,)], "k int")
    side = lambda *r: spark.createDataFrame([(x,) for x in r], "j int")
    keep = lambda r: sorted(x.k or 0 for x in joins.not_in(left, r, "k", "j").collect())
    assert (keep(side(1, 2)), keep(side(1, None)), keep(side())) == ([5], [], [0, 1, 5])
    assert "BroadcastNestedLoopJoin" in explained(joins.not_in(left, side(1), "k", "j")) and "LeftAnti" not in explained(joins.not_in(left, side(1), "k", "j"))  # one row of facts
    value = lambda op, kind, r: {x.k: x.mark for x in joins.quantified(left, r, "k", op, kind, "j").collect()}
    assert value("<", "any", side(2, 4)) == {1: True, 5: False, None: None}
    assert value("<", "any", side(2, None)) == {1: True, 5: None, None: None}
    assert value(">", "all", side(2, 4)) == {1: False, 5: True, None: None}
    assert value(">", "all", side(2, None)) == {1: False, 5: None, None: None}
    assert value("=", "all", side(5, 5)) == {1: False, 5: True, None: None}
    assert value("<>", "any", side(5, 5)) == {1: True, 5: False, None: None}
    assert value("<", "any", side()) == {1: False, 5: False, None: False} and value(">", "all", side()) == {1: True, 5: True, None: True}
    assert value("<", "all", side(None)) == {1: None, 5: None, None: None}


def explained(df) -> str:
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_asof_with_split_keys(spark):
    rng = random.Random(4)
    left = [(i, rng.choice(["a", "b", None]), rng.choice([None, rng.uniform(0, 100)])) for i in range(300)]
    right = [(100 + i, rng.choice(["a", "a", "b", None]), rng.choice([None, float(rng.randint(0, 100))])) for i in range(200)]
    l, r = spark.createDataFrame(left, "id int, k string, t double"), spark.createDataFrame(right, "v int, k string, at double")
    want = {i: max(((at, v) for v, kk, at in right if kk is not None and kk == k and at is not None and t is not None and at <= t), default=(None, None))[1] for i, k, t in left}
    for width in (None, 7, 1000):
        assert {x.id: x.v for x in joins.asof_join(l, r, ["k"], "t", "at", ["v"], ["v"], width=width).collect()} == want


def test_range_join_with_any_band(spark):
    rng = random.Random(5)
    points = [(i, rng.choice([None, rng.uniform(-50, 50), float("inf")])) for i in range(200)]
    bands = [(i, lo, lo + rng.choice([0.0, 0.5, 3.0, 5000.0, float("inf"), -1.0])) for i in range(60) for lo in [rng.uniform(-60, 60)]] + [(60, float("-inf"), 0.0), (61, None, 1.0), (62, -1e12, 1e12)]
    out = joins.range_join(spark.createDataFrame(points, "p int, x double"), spark.createDataFrame(bands, "b int, lo double, hi double"), "x", "lo", "hi", 1.0)
    assert sorted((r.p, r.b) for r in out.collect()) == sorted((p, b) for p, x in points for b, lo, hi in bands if x is not None and lo is not None and lo <= x < hi)


def test_scalar_subquery_of_two_rows_fails(spark):
    with pytest.raises(Exception, match="(?i)more than one row|SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        Engine(spark).register(SF, ["nation", "region"]).sql("SELECT (SELECT n_name FROM nation) AS x FROM region").collect()


def test_plan_accepts_json_and_sets(spark):
    engine = Engine(spark).register({"t": spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, s string")})
    read = {"op": "read", "table": "t", "columns": ["k"]}
    plan = {"op": "set", "kind": "except", "left": read, "right": {"op": "filter", "predicates": [{"call": [">", {"col": "k"}, 1]}], "input": read}}
    assert [r.k for r in engine.from_plan(json.dumps(plan)).collect()] == [1]
    case = {"op": "project", "columns": {"x": {"case": [[{"call": ["is null", {"col": "s"}]}, "none"]], "else": {"col": "s"}}}, "input": {"op": "read", "table": "t"}}
    assert sorted(r.x for r in engine.from_plan(case).collect()) == ["a", "b", "none"]
    with pytest.raises(ValueError):
        engine.from_plan({"op": "teleport"})


def test_filters_and_columns_reach_the_scan(spark):
    plan = Engine(spark).register(SF, ["lineitem"]).explain("SELECT l_orderkey FROM lineitem WHERE l_quantity > 10")
    assert "GreaterThan(l_quantity,10" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_positions_and_top_n(spark):
    df = spark.range(1000).withColumn("v", F.pmod(F.xxhash64("id"), F.lit(97)))
    numbered = joins.with_position(df, ["v", "id"], "p").orderBy("p").collect()
    assert [r.p for r in numbered] == list(range(1000)) and [(r.v, r.id) for r in numbered] == sorted((r.v, r.id) for r in numbered)
    assert relational.top_n(df, ["v", "id"], 3, 2).count() == 3
    assert relational.limit_percent(df, ["id"], 5).count() == 50


def test_sort_puts_nulls_last(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "a int")
    assert [r.a for r in relational.sort(df, ["a"]).collect()] == [1, 2, None]
    assert [r.a for r in relational.sort(df, [relational.ordering("a", descending=True)]).collect()] == [2, 1, None]


def test_streaming_windows(spark, tmp_path):
    from sparkmill.streaming import windows

    src = f"{SF}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(f"{SF}/events.parquet*")
    out = windows.tumbling(stream, "1 day", ["event_type"], [F.count("*").alias("n")], late="1 hour")
    q = out.writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) AS n FROM daily").first().n == spark.read.parquet(src).count()
