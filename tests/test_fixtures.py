"""The supply graph against its SQL on odd tables, and how often order lines are read for it."""

import random
import re

import duckdb

from riskloom.sources import fixtures


def odd_tables(spark, folder):
    rng = random.Random(6)
    some = lambda n, none=0.1: None if rng.random() < none else rng.randrange(n)
    rows = {
        "lineitem": ([(some(40), some(9), some(6), float(2**i % 10007) + i) for i in range(300)], "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double"),
        "orders": ([(k, some(8)) for k in range(35)], "o_orderkey long, o_custkey long"),
        "customer": ([(k, some(3), "MACHINERY", f"c{k}") for k in range(6)], "c_custkey long, c_nationkey int, c_mktsegment string, c_name string"),
        "supplier": ([(k, some(3), f"s{k}") for k in (*range(5), 3)], "s_suppkey long, s_nationkey int, s_name string"),
        "part": ([(k, f"b{k % 2}" if k else None, f"p{k}") for k in range(7)], "p_partkey long, p_brand string, p_name string"),
        "nation": ([(k, k % 2, f"n{k}") for k in range(3)], "n_nationkey int, n_regionkey int, n_name string"),
        "region": ([(k, f"r{k}") for k in range(2)], "r_regionkey int, r_name string"),
    }
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return rows


def test_graph_of_odd_tables(spark, tmp_path):
    con = duckdb.connect()
    for name in odd_tables(spark, str(tmp_path)):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(f"WITH {fixtures.GRAPH_CTES.strip()} SELECT src, dst, relation, weight FROM edges").fetchall()
    got = fixtures.supply_edges(spark, str(tmp_path)).select("src", "dst", "relation", "weight").collect()
    assert len(want) > 30 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_order_lines_are_read_twice(spark, tmp_path):
    odd_tables(spark, str(tmp_path))
    df = fixtures.raw_edges(spark, str(tmp_path))
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_partkey", plan)) == 2, plan
