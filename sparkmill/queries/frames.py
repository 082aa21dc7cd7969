"""Operator queries built with the DataFrame API and the package's operators, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmill.functions.exact import exact_sum
from sparkmill.operators import joins, relational
from sparkmill.session import Engine
from sparkmill.sources import scratch, tables
from sparkmill.sources.tables import table
from sparkmill.streaming import windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(oracle: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = oracle
        return f

    return keep


@registered("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as delimited text to the session's scratch folder and read with a schema."""
    path = scratch.place(spark, "csv")
    nation = table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    tables.write_delimited(nation, path)
    return tables.delimited(spark, path, nation.schema)


@registered("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 200000")
def copy_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query's result, written in folders by a column and read again."""
    path = scratch.place(spark, "copy")
    Engine(spark).register(sf_dir, ["orders"]).copy_out("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_totalprice > 200000", path, partition_by=["o_orderstatus"])
    return tables.parquet(spark, path)


@registered("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09)")
def join_not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", ["l_suppkey"], [F.col("l_quantity") == 50, F.col("l_discount") > 0.09])
    return joins.not_in(table(spark, sf_dir, "supplier", ["s_suppkey"]), lines, "s_suppkey", "l_suppkey")


@registered("""
SELECT p_partkey, p_retailprice < ANY (SELECT s_acctbal FROM supplier) AS below_one, p_retailprice > ALL (SELECT s_acctbal FROM supplier) AS above_all,
p_size = ANY (SELECT s_nationkey FROM supplier) AS in_one, p_size <> ALL (SELECT s_nationkey FROM supplier) AS in_none, p_size >= ALL (SELECT s_nationkey FROM supplier WHERE s_suppkey < 0) AS of_nothing FROM part
""")
def join_any_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, suppliers = table(spark, sf_dir, "part", ["p_partkey", "p_retailprice", "p_size"]), table(spark, sf_dir, "supplier", ["s_suppkey", "s_acctbal", "s_nationkey"])
    out = joins.quantified(part, suppliers, "p_retailprice", "<", "any", "s_acctbal", "below_one")
    out = joins.quantified(out, suppliers, "p_retailprice", ">", "all", "s_acctbal", "above_all")
    out = joins.quantified(out, suppliers, "p_size", "=", "any", "s_nationkey", "in_one")
    out = joins.quantified(out, suppliers, "p_size", "<>", "all", "s_nationkey", "in_none")
    return joins.quantified(out, suppliers.where("s_suppkey < 0"), "p_size", ">=", "all", "s_nationkey", "of_nothing").drop("p_retailprice", "p_size")


@registered("SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey")
def join_theta_lt(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("ak"), F.col("n_regionkey").alias("ar"), F.col("n_name").alias("low")), n.select(F.col("n_nationkey").alias("bk"), F.col("n_regionkey").alias("br"), F.col("n_name").alias("high"))
    return joins.theta_join(a, b, (F.col("ak") < F.col("bk")) & (F.col("ar") != F.col("br"))).select("low", "high")


@registered("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) AS mark FROM customer")
def join_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = table(spark, sf_dir, "orders", ["o_custkey"], [F.col("o_totalprice") > 450000])
    return joins.mark_join(table(spark, sf_dir, "customer", ["c_custkey"]), big, "c_custkey", "o_custkey")


@registered("""
SELECT c.event_id, p.event_id AS last_view FROM (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT max(event_id) AS event_id, user_id, ts FROM events WHERE event_type = 'view' GROUP BY user_id, ts) p
ON c.user_id = p.user_id AND c.ts >= p.ts
""")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", ["event_id", "user_id", "ts", "event_type"])
    clicks, views = events.where("event_type = 'click'").drop("event_type"), events.where("event_type = 'view'").withColumnRenamed("event_id", "last_view").withColumnRenamed("ts", "seen")
    return joins.asof_join(clicks, views, ["user_id"], "ts", "seen", ["last_view"], ["last_view"], width=86400).select("event_id", "last_view")


@registered("SELECT p_partkey, s_suppkey FROM part JOIN (SELECT s_suppkey, s_acctbal AS lo, s_acctbal + 15.0 AS hi FROM supplier) s ON p_retailprice >= lo AND p_retailprice < hi")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 15.0).alias("hi"))
    return joins.range_join(table(spark, sf_dir, "part", ["p_partkey", "p_retailprice"]), bands, "p_retailprice", "lo", "hi", 50.0).select("p_partkey", "s_suppkey")


@registered("SELECT s_suppkey, p_partkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) a FULL JOIN (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey DESC) AS j FROM part) b ON i = j")
def join_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part", ["p_partkey"]).withColumn("back", -F.col("p_partkey"))
    return joins.positional_join(table(spark, sf_dir, "supplier", ["s_suppkey"]), part, ["s_suppkey"], ["back"]).select("s_suppkey", "p_partkey")


@registered("SELECT s_suppkey, l_orderkey FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey AND l_quantity > 48 AND l_discount > 0.08")
def join_left_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_orderkey", "l_quantity", "l_discount"])
    s = table(spark, sf_dir, "supplier", ["s_suppkey"])
    return relational.join(s, lines, F.col("s_suppkey") == F.col("l_suppkey"), "left", (F.col("l_quantity") > 48) & (F.col("l_discount") > 0.08)).select("s_suppkey", "l_orderkey")


@registered("SELECT l_returnflag, cast(sum(cast(l_extendedprice * (1 - l_discount) AS decimal(18, 4))) AS double) AS revenue FROM lineitem GROUP BY l_returnflag")
def agg_exact_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", ["l_returnflag", "l_extendedprice", "l_discount"])
    return relational.aggregate(lines, ["l_returnflag"], [exact_sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue")])


@registered("SELECT l_returnflag, count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS f, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS o FROM lineitem GROUP BY l_returnflag")
def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "lineitem", ["l_returnflag", "l_linestatus"]).groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return counted.select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@registered("SELECT p_brand, cast(floor(stddev_samp(p_size) * 1000) AS bigint) AS sd, cast(median(p_size) AS double) AS mid FROM part GROUP BY p_brand")
def stddev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", ["p_brand", "p_size"]).groupBy("p_brand").agg(F.floor(F.stddev_samp("p_size") * 1000).alias("sd"), F.median("p_size").alias("mid"))


@registered("SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS segments FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) t GROUP BY c_nationkey")
def string_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer", ["c_nationkey", "c_mktsegment"])
    return c.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"))


@registered("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM customer)")
def limit_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.limit_percent(table(spark, sf_dir, "customer", ["c_custkey"]), ["c_custkey"], 10)


@registered("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) t WHERE rn = 1")
def distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.distinct_on(table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey"]), ["o_custkey"], ["o_orderkey"])


@registered("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def unnest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", ["p_partkey", "p_name"]).select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@registered("SELECT vec_id, len(embedding) AS dims, CAST(embedding[1] AS DOUBLE) AS head FROM embeddings")
def array_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dims"), F.get("embedding", F.lit(0)).cast("double").alias("head"))


@registered("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.none') IS NULL AS lacks FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events", ["event_id", "props"])
    return events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.none").isNull().alias("lacks"))


@registered("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(table(spark, sf_dir, "events", ["ts", "event_type"]), "1 day", ["event_type"], [F.count("*").alias("n")])


@registered("SELECT date_trunc('day', ts) - to_days(CAST(back AS INTEGER)) AS window_start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS back) GROUP BY 1, 2")
def sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(table(spark, sf_dir, "events", ["ts", "event_type"]), "2 days", ["event_type"], [F.count("*").alias("n")], slide="1 day")


@registered("SELECT cast(floor(stddev_samp(p_size) * 1000) AS bigint) AS sd, cast(median(p_size) AS double) AS mid, cast(quantile_cont(p_size, 0.25) AS double) AS low FROM part")
def agg_ungrouped_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part", ["p_size"]).agg(F.floor(F.stddev_samp("p_size") * 1000).alias("sd"), F.median("p_size").alias("mid"), F.percentile("p_size", 0.25).alias("low"))


@registered("SELECT string_agg(r_name, ', ' ORDER BY r_name) AS names FROM region")
def string_agg_ungrouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region", ["r_name"]).agg(F.array_join(F.array_sort(F.collect_list("r_name")), ", ").alias("names"))


@registered("""
WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM g GROUP BY user_id, s
""")
def session_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(table(spark, sf_dir, "events", ["ts", "user_id"]), "6 hours", ["user_id"], [F.count("*").alias("n")])


@registered("SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND o_totalprice > 1000 GROUP BY o_orderstatus ORDER BY n DESC LIMIT 2")
def structured_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan entry: read, filter, join, aggregate, sort and fetch from a nested dict."""
    engine = Engine(spark).register(sf_dir, ["orders", "customer"])
    return engine.from_plan({
        "op": "fetch", "count": 2, "input": {"op": "sort", "keys": [{"col": "n", "desc": True}], "input": {
            "op": "aggregate", "keys": ["o_orderstatus"], "aggregates": {"n": {"fn": "count_star"}, "top": {"fn": "max", "arg": {"col": "o_totalprice"}}},
            "input": {"op": "filter", "predicates": [{"call": ["=", {"col": "c_mktsegment"}, "BUILDING"]}, {"call": [">", {"col": "o_totalprice"}, 1000]}],
                      "input": {"op": "join", "condition": {"call": ["=", {"col": "o_custkey"}, {"col": "c_custkey"}]}, "left": {"op": "read", "table": "orders"}, "right": {"op": "read", "table": "customer"}}}}}})


@registered("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F'")
def prepared_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark).register(sf_dir, ["orders"]).sql("SELECT o_orderkey FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status", least=300000, status="F")


@registered("SELECT o_orderkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'O'")
def prepared_positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark).register(sf_dir, ["orders"])
    engine.sql("PREPARE dear AS SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?")
    return engine.sql("EXECUTE dear(300000, 'O')")


@registered("SELECT n_name, r_name, rank() OVER (PARTITION BY r_name ORDER BY n_name) AS place FROM nation, region WHERE n_regionkey = r_regionkey AND r_name IN (SELECT r_name FROM region WHERE r_regionkey > 1)")
def structured_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan entry: cross join, filter, semi join and a window from a nested dict."""
    read = lambda t: {"op": "read", "table": t}
    some = {"op": "project", "columns": {"wanted": {"col": "r_name"}}, "input": {"op": "filter", "predicates": [{"call": [">", {"col": "r_regionkey"}, 1]}], "input": read("region")}}
    pairs = {"op": "filter", "predicates": [{"call": ["=", {"col": "n_regionkey"}, {"col": "r_regionkey"}]}], "input": {"op": "cross", "left": read("nation"), "right": read("region")}}
    semi = {"op": "join", "how": "left_semi", "condition": {"call": ["=", {"col": "r_name"}, {"col": "wanted"}]}, "left": pairs, "right": some}
    ranked = {"op": "window", "keys": ["r_name"], "order": [{"col": "n_name"}], "columns": {"place": {"fn": "rank"}}, "input": semi}
    out = Engine(spark).register(sf_dir, ["nation", "region"]).from_plan({"op": "project", "columns": {"n_name": {"col": "n_name"}, "r_name": {"col": "r_name"}, "place": {"cast": [{"col": "place"}, "long"]}}, "input": ranked})
    return out


@registered("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def cached_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, cache_size="1 GB").register(sf_dir, ["customer"])
    return engine.cache("customer", ["c_mktsegment"], "segments").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@registered("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 3")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_totalprice"]).withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn")


def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bernoulli sample with a seed (engine-specific rows, so without oracle)."""
    return table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber"]).sample(0.1, seed=7)


QUERIES["sample"] = sample
