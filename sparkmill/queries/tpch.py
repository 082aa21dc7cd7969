"""The 22 queries of the public decision-support benchmark specification (TPC-H), moved to the driver's schema.

One text serves Spark and the oracle. Their shapes, predicates and orders are the
specification's; columns that the schema lacks are replaced by near ones, and
``ps`` stands for the missing part-supplier table: the least price and the
quantity of each (part, supplier) in ``lineitem``, of the parts or suppliers that
the query selects. Sums of products go through decimals, so that they do not
depend on the order of addition. Keys have no nulls, so q16 may ask NOT EXISTS
for the specification's NOT IN, which Spark could only plan as a broadcast.
"""

from __future__ import annotations

QUERIES: dict[str, str] = {
    "q01": """
    select l_returnflag, l_linestatus, sum(l_quantity) sum_qty, cast(sum(cast(l_extendedprice as decimal(18, 2))) as double) sum_base_price, cast(sum(cast(l_extendedprice*(1-l_discount) as decimal(18, 4))) as double) sum_disc_price, cast(sum(cast(l_extendedprice*(1-l_discount)*(1+l_tax) as decimal(18, 6))) as double) sum_charge, avg(l_quantity) avg_qty, cast(sum(cast(l_extendedprice as decimal(18, 2))) as double)/count(*) avg_price, cast(sum(cast(l_discount as decimal(18, 2))) as double)/count(*) avg_disc, count(*) count_order
    from lineitem
    where l_shipdate<=timestamp '2000-09-02 00:00:00'
    group by 1, 2
    order by l_returnflag, l_linestatus
    """,
    "q02": """
    with ps as materialized (select l_partkey ps_partkey, l_suppkey ps_suppkey, min(l_extendedprice) ps_supplycost, sum(l_quantity) ps_availqty from lineitem where l_partkey in (select p_partkey from part where p_size=15 and p_type='PROMO') group by l_partkey, l_suppkey)
    select s_acctbal, s_name, n_name, p_partkey
    from part, supplier, ps, nation, region
    where p_partkey=ps_partkey and s_suppkey=ps_suppkey and p_size=15 and p_type='PROMO' and s_nationkey=n_nationkey and n_regionkey=r_regionkey and r_name='EUROPE' and ps_supplycost=(select min(ps_supplycost) from ps, supplier, nation, region where p_partkey=ps_partkey and s_suppkey=ps_suppkey and s_nationkey=n_nationkey and n_regionkey=r_regionkey and r_name='EUROPE')
    order by s_acctbal desc, n_name, s_name, p_partkey
    """,
    "q03": """
    select l_orderkey, cast(sum(cast(l_extendedprice*(1-l_discount) as decimal(18, 4))) as double) revenue, o_orderdate
    from customer, orders, lineitem
    where c_mktsegment='BUILDING' and c_custkey=o_custkey and l_orderkey=o_orderkey and o_orderdate<timestamp '1998-03-15 00:00:00' and l_shipdate>timestamp '1998-03-15 00:00:00'
    group by l_orderkey, o_orderdate
    order by revenue desc, o_orderdate
    """,
    "q04": """
    select o_orderpriority, count(*) n
    from orders
    where o_orderdate>=timestamp '1997-07-01 00:00:00' and o_orderdate<timestamp '1997-10-01 00:00:00' and exists(select * from lineitem where l_orderkey=o_orderkey and l_discount>l_tax)
    group by 1
    order by o_orderpriority
    """,
    "q05": """
    select n_name, cast(sum(cast(l_extendedprice*(1-l_discount) as decimal(18, 4))) as double) r
    from customer, orders, lineitem, supplier, nation, region
    where c_custkey=o_custkey and l_orderkey=o_orderkey and l_suppkey=s_suppkey and c_nationkey=s_nationkey and s_nationkey=n_nationkey and n_regionkey=r_regionkey and r_name='ASIA' and o_orderdate>=timestamp '1997-01-01 00:00:00' and o_orderdate<timestamp '1999-01-01 00:00:00'
    group by 1
    order by r desc
    """,
    "q06": """
    select cast(sum(cast(l_extendedprice*l_discount as decimal(18, 4))) as double) r
    from lineitem
    where l_shipdate>=timestamp '1997-01-01 00:00:00' and l_shipdate<timestamp '1998-01-01 00:00:00' and l_discount between 0.05 and 0.07 and l_quantity<24
    """,
    "q07": """
    select n1.n_name sn, n2.n_name cn, cast(year(l_shipdate) as int) y, cast(sum(cast(l_extendedprice*(1-l_discount) as decimal(18, 4))) as double) r
    from supplier, lineitem, orders, customer, nation n1, nation n2
    where s_suppkey=l_suppkey and o_orderkey=l_orderkey and c_custkey=o_custkey and s_nationkey=n1.n_nationkey and c_nationkey=n2.n_nationkey and ((n1.n_name='NATION_6' and n2.n_name='NATION_7') or (n1.n_name='NATION_7' and n2.n_name='NATION_6'))
    group by 1, 2, 3
    order by sn, cn, y
    """,
    "q08": """
    select cast(year(o_orderdate) as int) y, cast(sum(case when n2.n_name='NATION_1' then cast(l_extendedprice*(1-l_discount) as decimal(18, 4)) else cast(0 as decimal(18, 4)) end) as double)/cast(sum(cast(l_extendedprice*(1-l_discount) as decimal(18, 4))) as double) m
    from part, supplier, lineitem, orders, customer, nation n1, nation n2, region
    where p_partkey=l_partkey and s_suppkey=l_suppkey and l_orderkey=o_orderkey and o_custkey=c_custkey and c_nationkey=n1.n_nationkey and n1.n_regionkey=r_regionkey and r_name='AMERICA' and s_nationkey=n2.n_nationkey and p_type='ECONOMY'
    group by 1
    order by y
    """,
    "q09": """
    with ps as (select l_partkey ps_partkey, l_suppkey ps_suppkey, min(l_extendedprice) ps_supplycost, sum(l_quantity) ps_availqty from lineitem where l_partkey in (select p_partkey from part where p_name like '%red%') group by l_partkey, l_suppkey)
    select n_name, cast(year(o_orderdate) as int) y, cast(sum(cast(l_extendedprice*(1-l_discount)-ps_supplycost*l_quantity as decimal(18, 4))) as double) p
    from part, supplier, lineitem, ps, orders, nation
    where s_suppkey=l_suppkey and ps_suppkey=l_suppkey and ps_partkey=l_partkey and p_partkey=l_partkey and o_orderkey=l_orderkey and s_nationkey=n_nationkey and p_name like '%red%'
    group by 1, 2
    order by n_name, y desc
    """,
    "q10": """
    select c_custkey, c_name, cast(sum(cast(l_extendedprice*(1-l_discount) as decimal(18, 4))) as double) r, c_acctbal, n_name
    from customer, orders, lineitem, nation
    where c_custkey=o_custkey and l_orderkey=o_orderkey and o_orderdate>=timestamp '1997-10-01 00:00:00' and o_orderdate<timestamp '1998-01-01 00:00:00' and l_returnflag='R' and c_nationkey=n_nationkey
    group by c_custkey, c_name, c_acctbal, n_name
    order by c_custkey, r desc
    """,
    "q11": """
    with ps as materialized (select l_partkey ps_partkey, l_suppkey ps_suppkey, min(l_extendedprice) ps_supplycost, sum(l_quantity) ps_availqty from lineitem where l_suppkey in (select s_suppkey from supplier, nation where s_nationkey=n_nationkey and n_name='NATION_7') group by l_partkey, l_suppkey)
    select *
    from (select ps_partkey, cast(sum(cast(ps_supplycost*ps_availqty as decimal(18, 2))) as double) v from ps, supplier, nation where ps_suppkey=s_suppkey and s_nationkey=n_nationkey and n_name='NATION_7' group by 1) t
    where v>(select sum(ps_supplycost*ps_availqty)*0.001 from ps, supplier, nation where ps_suppkey=s_suppkey and s_nationkey=n_nationkey and n_name='NATION_7')
    order by v desc, ps_partkey
    """,
    "q12": """
    select l_linestatus, sum(case when o_orderpriority='1-URGENT' or o_orderpriority='2-HIGH' then cast(1 as double) else cast(0 as double) end) h, sum(case when o_orderpriority<>'1-URGENT' and o_orderpriority<>'2-HIGH' then cast(1 as double) else cast(0 as double) end) l
    from orders, lineitem
    where o_orderkey=l_orderkey and l_returnflag in ('A', 'R') and l_shipdate>o_orderdate
    group by 1
    order by l_linestatus
    """,
    "q13": """
    select c_count, count(*) d
    from (select c_custkey, count(o_orderkey) c_count from customer left outer join orders on (c_custkey=o_custkey and o_orderpriority not like '%NOT%SPEC%') group by 1) t
    group by 1
    order by d desc, c_count desc
    """,
    "q14": """
    select cast(100.0 as double)*cast(sum(case when p_type like 'PROMO%' then cast(l_extendedprice*(1-l_discount) as decimal(18, 4)) else cast(0 as decimal(18, 4)) end) as double)/cast(sum(cast(l_extendedprice*(1-l_discount) as decimal(18, 4))) as double) p
    from lineitem, part
    where l_partkey=p_partkey and l_shipdate>=timestamp '1997-09-01 00:00:00' and l_shipdate<timestamp '1997-10-01 00:00:00'
    """,
    "q15": """
    with r as materialized (select l_suppkey k, cast(sum(cast(l_extendedprice*(1-l_discount) as decimal(18, 4))) as double) t from lineitem where l_shipdate>=timestamp '1998-01-01 00:00:00' and l_shipdate<timestamp '1998-04-01 00:00:00' group by 1)
    select s_suppkey, t
    from supplier, r
    where s_suppkey=k and t=(select max(t) from r)
    order by s_suppkey
    """,
    "q16": """
    with ps as (select l_partkey ps_partkey, l_suppkey ps_suppkey, min(l_extendedprice) ps_supplycost, sum(l_quantity) ps_availqty from lineitem where l_partkey in (select p_partkey from part where p_brand<>'Brand#4' and p_type not like 'PROMO%' and p_size in (49, 14, 23, 45, 19, 3, 36, 9)) group by l_partkey, l_suppkey)
    select p_brand, p_type, p_size, count(distinct ps_suppkey) n
    from ps, part
    where p_partkey=ps_partkey and p_brand<>'Brand#4' and p_type not like 'PROMO%' and p_size in (49, 14, 23, 45, 19, 3, 36, 9) and not exists(select * from supplier where s_suppkey=ps_suppkey and s_acctbal<0)
    group by 1, 2, 3
    order by n desc, p_brand, p_type, p_size
    """,
    "q17": """
    select cast(sum(cast(l_extendedprice as decimal(18, 2))) as double)/cast(7 as double) a
    from lineitem, part
    where p_partkey=l_partkey and p_brand='Brand#4' and l_quantity<(select avg(l_quantity)*0.2 from lineitem where l_partkey=p_partkey)
    """,
    "q18": """
    select c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) q
    from customer, orders, lineitem
    where o_orderkey in (select l_orderkey from lineitem group by 1 having sum(l_quantity)>300) and c_custkey=o_custkey and o_orderkey=l_orderkey
    group by 1, 2, 3, 4, 5
    order by o_totalprice desc, o_orderdate, o_orderkey
    """,
    "q19": """
    select cast(sum(cast(l_extendedprice*(1-l_discount) as decimal(18, 4))) as double) r
    from lineitem, part
    where p_partkey=l_partkey and ((p_brand='Brand#12' and p_type in ('SMALL', 'PROMO') and l_quantity>=1 and l_quantity<=11 and p_size between 1 and 5) or (p_brand='Brand#23' and p_type in ('MEDIUM', 'LARGE') and l_quantity>=10 and l_quantity<=20 and p_size between 1 and 10) or (p_brand='Brand#4' and p_type in ('LARGE', 'ECONOMY') and l_quantity>=20 and l_quantity<=30 and p_size between 1 and 15))
    """,
    "q20": """
    with ps as (select l_partkey ps_partkey, l_suppkey ps_suppkey, min(l_extendedprice) ps_supplycost, sum(l_quantity) ps_availqty from lineitem where l_partkey in (select p_partkey from part where p_name like 'red%') group by l_partkey, l_suppkey)
    select s_name
    from supplier, nation
    where s_suppkey in (select ps_suppkey from ps where ps_partkey in (select p_partkey from part where p_name like 'red%') and ps_availqty>(select 0.5*sum(l_quantity) from lineitem where l_partkey=ps_partkey and l_suppkey=ps_suppkey and l_shipdate>=timestamp '1997-01-01 00:00:00' and l_shipdate<timestamp '1998-01-01 00:00:00')) and s_nationkey=n_nationkey and n_name='NATION_3'
    order by s_name
    """,
    "q21": """
    select s_name, count(*) n
    from supplier, lineitem l1, orders, nation
    where s_suppkey=l1.l_suppkey and o_orderkey=l1.l_orderkey and o_orderstatus='F' and l1.l_discount>l1.l_tax and exists(select * from lineitem l2 where l2.l_orderkey=l1.l_orderkey and l2.l_suppkey<>l1.l_suppkey) and not exists(select * from lineitem l3 where l3.l_orderkey=l1.l_orderkey and l3.l_suppkey<>l1.l_suppkey and l3.l_discount>l3.l_tax) and s_nationkey=n_nationkey and n_regionkey=1
    group by 1
    order by n desc, s_name
    """,
    "q22": """
    select k, count(*) n, cast(sum(cast(c_acctbal as decimal(18, 2))) as double) t
    from (select substr(c_mktsegment, 1, 2) k, c_acctbal from customer where substr(c_mktsegment, 1, 2) in ('BU', 'MA', 'FU') and c_acctbal>(select avg(c_acctbal) from customer where c_acctbal>0.00 and substr(c_mktsegment, 1, 2) in ('BU', 'MA', 'FU')) and not exists(select * from orders where o_custkey=c_custkey and o_totalprice>450000)) t
    group by 1
    order by k
    """,
}
