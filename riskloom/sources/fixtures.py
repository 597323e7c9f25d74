"""The typed supply graph that the relational tables describe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from riskloom.functions.shared import materialize
from riskloom.operators.graph import alternatives, criticality_weights

_KINDS = ("S", "P", "C", "N", "R")
_RELATIONS = ("alternative_to", "depends_on", "located_in", "ships_through", "supplies")  # by letters


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def _cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def _top(sales: DataFrame, by: list[str], other: str, n: int) -> DataFrame:
    """The n best ``other`` of each ``by`` by revenue, ties to the smaller key."""
    order = Window.partitionBy(*by).orderBy(F.desc("revenue"), other)
    return sales.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges before pairs collapse, in numbers: (src_kind, src, dst_kind, dst, relation), the last by place in ``_RELATIONS``.

    Order lines are dealt once by part and, with their customers, once by customer; what is summed up there needs no
    further exchange, nor a first sum over keys that hardly repeat. The tables of single keys are built into hash joins.
    """
    read = lambda n: table(spark, sf_dir, n)
    revenue = F.sum("cents").alias("revenue")
    lines = read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", _cents("l_extendedprice").alias("cents"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given, so that they stay small in a union of several exchanges
    of_part = lines.select("l_partkey", "l_suppkey", "cents").repartition(tasks, "l_partkey")
    sold = of_part.groupBy("l_partkey", "l_suppkey").agg(revenue)
    buyers = read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    bought = lines.join(buyers.hint("shuffle_hash"), "l_orderkey").select("o_custkey", "l_partkey", "l_suppkey", "cents").repartition(tasks, "o_custkey")
    # every line once for its part and once for its supplier
    twice = bought.select("o_custkey", F.stack(F.lit(2), F.lit(0), F.col("l_partkey"), F.col("cents"), F.lit(1), F.col("l_suppkey"), F.col("cents")).alias("what", "other", "cents"))
    best = _top(twice.groupBy("o_custkey", "what", "other").agg(revenue), ["o_custkey", "what"], "other", 1)
    # left joins with a mark: what an inner join would ask of the keys would keep both uses of an exchange apart
    met = F.col("met").isNotNull()
    inner = [F.sum(F.when(met, F.col("cents"))).alias("revenue"), F.count_if(met).alias("n_met")]
    home = read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", F.lit(True).alias("met"))
    shipped = twice.where("what = 1").join(home.hint("shuffle_hash"), "o_custkey", "left").select(F.col("other").alias("l_suppkey"), "c_nationkey", "cents", "met")
    by_nation = shipped.repartition(tasks, "l_suppkey").groupBy("l_suppkey", "c_nationkey").agg(*inner).where("n_met > 0")
    brands = read("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", F.lit(True).alias("met"))
    branded = of_part.join(brands.hint("shuffle_hash"), "l_partkey", "left").select("p_brand", "l_suppkey", "cents", "met")
    by_brand = branded.repartition(tasks, "l_suppkey").groupBy("p_brand", "l_suppkey").agg(*inner).where("n_met > 0")
    ranked = _top(by_brand, ["p_brand"], "l_suppkey", 3)
    first = ranked.where("rank = 1").select("p_brand", F.col("l_suppkey").alias("best"))

    def edge(df: DataFrame, src_kind: str, src: str, dst_kind: str, dst: str, relation: Column) -> DataFrame:
        kind = lambda k, c: F.when(F.col(c).isNotNull(), F.lit(_KINDS.index(k))).alias
        return df.select(kind(src_kind, src)("src_kind"), F.col(src).cast("long").alias("src"), kind(dst_kind, dst)("dst_kind"), F.col(dst).cast("long").alias("dst"), relation.alias("relation"))

    is_a = lambda name: F.lit(_RELATIONS.index(name))
    parts = [
        edge(_top(sold, ["l_partkey"], "l_suppkey", 2), "S", "l_suppkey", "P", "l_partkey", is_a("supplies")),
        _choices(best),
        edge(read("supplier"), "S", "s_suppkey", "N", "s_nationkey", is_a("located_in")),
        edge(read("customer"), "C", "c_custkey", "N", "c_nationkey", is_a("located_in")),
        edge(read("nation"), "N", "n_nationkey", "R", "n_regionkey", is_a("located_in")),
        edge(_top(by_nation, ["l_suppkey"], "c_nationkey", 1), "S", "l_suppkey", "N", "c_nationkey", is_a("ships_through")),
        edge(ranked.where("rank > 1").join(first, "p_brand"), "S", "l_suppkey", "S", "best", is_a("alternative_to")).distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _choices(best: DataFrame) -> DataFrame:
    """A customer's part supplies it (what = 0), it depends on its supplier (what = 1)."""
    kind = lambda k, c: F.when(F.col(c).isNotNull(), F.lit(_KINDS.index(k)))
    part = F.col("what") == 0
    return best.select(
        F.when(part, kind("P", "other")).otherwise(kind("C", "o_custkey")).alias("src_kind"), F.when(part, F.col("other")).otherwise(F.col("o_custkey")).alias("src"),
        F.when(part, kind("C", "o_custkey")).otherwise(kind("S", "other")).alias("dst_kind"), F.when(part, F.col("o_custkey")).otherwise(F.col("other")).alias("dst"),
        F.when(part, _RELATIONS.index("supplies")).otherwise(_RELATIONS.index("depends_on")).alias("relation"),
    )


def _named(links: DataFrame) -> DataFrame:
    """Links in numbers as (src, dst, relation) by name."""

    def name(kind: str, number: str) -> Column:
        prefix = F.element_at(F.array(*(F.lit(k + ":") for k in _KINDS)), F.col(kind) + 1)
        return F.concat(prefix, F.col(number).cast("string"))

    return links.select(name("src_kind", "src").alias("src"), name("dst_kind", "dst").alias("dst"), F.element_at(F.array(*map(F.lit, _RELATIONS)), F.col("relation") + 1).alias("relation"))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All (src, dst, relation) before pairs collapse."""
    return _named(_links(spark, sf_dir))


def supply_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, entity_type, label) of all suppliers, parts, customers, nations and regions."""
    read = lambda n: table(spark, sf_dir, n)
    maker = F.when(F.col("c_mktsegment") == "MACHINERY", "Manufacturer").otherwise("Customer")
    one = lambda n, p, k, t, label: read(n).select(_key(p, k).alias("name"), t.alias("entity_type"), F.col(label).alias("label"))
    return (
        one("supplier", "S", "s_suppkey", F.lit("Supplier"), "s_name")
        .unionByName(one("part", "P", "p_partkey", F.lit("Part"), "p_name"))
        .unionByName(one("customer", "C", "c_custkey", maker, "c_name"))
        .unionByName(one("nation", "N", "n_nationkey", F.lit("Region"), "n_name"))
        .unionByName(one("region", "R", "r_regionkey", F.lit("Region"), "r_name"))
    )


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weighted edge per ordered pair: (src, dst, relation, weight). Pairs collapse in numbers, to the alphabetically last relation."""
    ends = ["src_kind", "src", "dst_kind", "dst"]
    links = materialize(_links(spark, sf_dir).groupBy(*ends).agg(F.max("relation").alias("relation")), "links")
    swaps = _named(links.where(F.col("relation") == _RELATIONS.index("alternative_to")))
    return criticality_weights(_named(links), materialize(alternatives(swaps), "alternatives"))


#: The same graph in DuckDB SQL, as common table expressions.
GRAPH_CTES = """
lines AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem),
bought AS (SELECT o_custkey, l_partkey, l_suppkey, cents FROM lines JOIN orders ON l_orderkey = o_orderkey),
sold AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_partkey ORDER BY sum(cents) DESC, l_suppkey) AS rank FROM lines GROUP BY l_suppkey, l_partkey),
by_part AS (SELECT o_custkey, l_partkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sum(cents) DESC, l_partkey) AS rank FROM bought GROUP BY o_custkey, l_partkey),
by_supplier AS (SELECT o_custkey, l_suppkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sum(cents) DESC, l_suppkey) AS rank FROM bought GROUP BY o_custkey, l_suppkey),
by_nation AS (SELECT l_suppkey, c_nationkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(cents) DESC, c_nationkey) AS rank
  FROM bought JOIN customer ON o_custkey = c_custkey GROUP BY l_suppkey, c_nationkey),
by_brand AS (SELECT p_brand, l_suppkey, row_number() OVER (PARTITION BY p_brand ORDER BY sum(cents) DESC, l_suppkey) AS rank
  FROM lines JOIN part ON l_partkey = p_partkey GROUP BY p_brand, l_suppkey),
raw_edges AS MATERIALIZED (
  SELECT 'S:' || l_suppkey AS src, 'P:' || l_partkey AS dst, 'supplies' AS relation FROM sold WHERE rank <= 2
  UNION ALL SELECT 'P:' || l_partkey, 'C:' || o_custkey, 'supplies' FROM by_part WHERE rank = 1
  UNION ALL SELECT 'C:' || o_custkey, 'S:' || l_suppkey, 'depends_on' FROM by_supplier WHERE rank = 1
  UNION ALL SELECT 'S:' || s_suppkey, 'N:' || s_nationkey, 'located_in' FROM supplier
  UNION ALL SELECT 'C:' || c_custkey, 'N:' || c_nationkey, 'located_in' FROM customer
  UNION ALL SELECT 'N:' || n_nationkey, 'R:' || n_regionkey, 'located_in' FROM nation
  UNION ALL SELECT 'S:' || l_suppkey, 'N:' || c_nationkey, 'ships_through' FROM by_nation WHERE rank = 1
  UNION ALL (SELECT DISTINCT 'S:' || a.l_suppkey, 'S:' || b.l_suppkey, 'alternative_to' FROM by_brand a JOIN by_brand b USING (p_brand)
    WHERE a.rank IN (2, 3) AND b.rank = 1)),
pairs AS MATERIALIZED (SELECT src, dst, max(relation) AS relation FROM raw_edges GROUP BY src, dst),
edges AS MATERIALIZED (SELECT src, dst, relation, CASE WHEN relation = 'alternative_to' THEN 0.0
  WHEN relation IN ('supplies', 'depends_on') THEN round(1.0::DOUBLE / (1 + count(*) FILTER (relation = 'alternative_to') OVER (PARTITION BY src)), 3)
  ELSE 1.0 END::DOUBLE AS weight FROM pairs),
nodes AS MATERIALIZED (
  SELECT 'S:' || s_suppkey AS name, 'Supplier' AS entity_type, s_name AS label FROM supplier
  UNION ALL SELECT 'P:' || p_partkey, 'Part', p_name FROM part
  UNION ALL SELECT 'C:' || c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Manufacturer' ELSE 'Customer' END, c_name FROM customer
  UNION ALL SELECT 'N:' || n_nationkey, 'Region', n_name FROM nation
  UNION ALL SELECT 'R:' || r_regionkey, 'Region', r_name FROM region)
"""
