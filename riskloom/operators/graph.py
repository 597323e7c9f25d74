"""Building, weighing, measuring and walking the typed graph.

Edges are (src, dst, relation, ...), nodes (name, entity_type, ...); everything is a
DataFrame transformation. Walks are bounded loops whose state is written to the
shared folder each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from riskloom.functions.shared import materialize
from riskloom.operators.components import connected_components


def collapse_pairs(edges: DataFrame, last: Column) -> DataFrame:
    """One edge per (src, dst): the row whose ``last`` is greatest wins, of equal ones that of greater other columns."""
    others = [c for c in edges.columns if c not in ("src", "dst")]
    best = edges.groupBy("src", "dst").agg(F.max_by(F.struct(*others), F.struct(last, *others)).alias("e"))
    return best.select("src", "dst", *[F.col("e")[c].alias(c) for c in others])


def alternatives(edges: DataFrame) -> DataFrame:
    """(src, n_alts): how many alternatives each source has."""
    return edges.where("relation = 'alternative_to'").groupBy("src").agg(F.count("*").alias("n_alts"))


def criticality_weights(edges: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """Weight 0 for alternatives, 1 / (1 + alternatives of the source) for supply relations, else 1.

    Alternatives are counted first (or given as ``counted``) and joined, so a hub's edges are not gathered in one window.
    """
    joined = edges.join(alternatives(edges) if counted is None else counted, "src", "left")
    share = F.round(F.lit(1.0) / (1 + F.coalesce("n_alts", F.lit(0))), 3)
    weight = F.when(F.col("relation") == "alternative_to", 0.0).when(F.col("relation").isin("supplies", "depends_on"), share).otherwise(1.0)
    return joined.select(*edges.columns, weight.alias("weight")) if "weight" not in edges.columns else joined.withColumn("weight", weight).select(*edges.columns)


def nodes_from_triples(triples: DataFrame, seq: str = "seq") -> DataFrame:
    """Nodes of (head, head_type, tail, tail_type, seq): the first type seen wins; heads come before tails."""
    head = triples.select(F.col("head").alias("name"), F.col("head_type").alias("entity_type"), (2 * F.col(seq)).alias("at"))
    tail = triples.select(F.col("tail"), F.col("tail_type"), (2 * F.col(seq) + 1).alias("at")).toDF("name", "entity_type", "at")
    first = head.unionByName(tail).groupBy("name").agg(F.min_by("entity_type", F.struct("at", "entity_type")).alias("entity_type"))
    return first.withColumn("entity_type", F.coalesce(F.nullif("entity_type", F.lit("")), F.lit("Supplier")))


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst")


def isolated_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).distinct()
    return nodes.join(ends, "name", "left_anti")


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each pair once."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, degree, centrality): in + out degree, over n - 1."""
    ends = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name")))
    counts = ends.groupBy("name").agg(F.count("*").alias("degree"))
    n = nodes.agg(F.count("*").alias("n"))
    joined = nodes.select("name").join(counts, "name", "left").crossJoin(F.broadcast(n))  # one row
    degree = F.coalesce("degree", F.lit(0)).cast("long")
    return joined.select("name", degree.alias("degree"), F.when(F.col("n") > 1, degree / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, component): the least node name of each weakly connected part."""
    found = connected_components(edges, "src", "dst")
    return nodes.select("name").join(found, nodes.name == found.node, "left").select("name", F.coalesce("component", "name").alias("component"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node and edge counts, average out-degree, number of weak components, whether connected."""
    wcc = weak_components(nodes, edges).agg(F.count_distinct("component").alias("n_components"))
    n = nodes.agg(F.count("*").alias("n_nodes"))
    m = edges.agg(F.count("*").alias("n_edges"))
    row = n.crossJoin(m).crossJoin(wcc)  # one row each
    return row.withColumns({"connected": F.col("n_components") == 1, "edges_per_node": F.coalesce(F.try_divide("n_edges", "n_nodes"), F.lit(0.0))})


def bfs_distances(edges: DataFrame, seeds: DataFrame, radius: int) -> DataFrame:
    """(name, dist) of nodes within ``radius`` undirected hops of any seed (name)."""
    both = materialize(undirected(edges), "bfs-edges")
    seen = materialize(seeds.select("name").distinct().withColumn("dist", F.lit(0)), "bfs")
    for d in range(1, radius + 1):
        step = seen.where(F.col("dist") == d - 1).join(both, F.col("name") == F.col("src")).select(F.col("dst").alias("name")).distinct()
        new = step.join(seen, "name", "left_anti").withColumn("dist", F.lit(d))
        seen = materialize(seen.unionByName(new), "bfs")
    return seen


def induced_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among ``nodes`` (name)."""
    names = nodes.select("name").distinct()
    inner = edges.join(names.withColumnRenamed("name", "src"), "src", "left_semi")
    return inner.join(names.withColumnRenamed("name", "dst"), "dst", "left_semi").select(*edges.columns)


def add_missing_nodes(nodes: DataFrame, extra: DataFrame) -> DataFrame:
    """Append nodes that are not there yet."""
    return nodes.unionByName(extra.join(nodes, "name", "left_anti").dropDuplicates(["name"]))


def add_missing_edges(edges: DataFrame, extra: DataFrame) -> DataFrame:
    """Append edges whose (src, dst) is not there yet."""
    fresh = extra.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").dropDuplicates(["src", "dst"])
    return edges.unionByName(fresh.select(*edges.columns))


def overlap_is_stale(members: DataFrame, nodes: DataFrame, least: int = 500, share: float = 0.20) -> DataFrame:
    """One row: whether a stored partition overlaps the graph too little (either bound missed)."""
    common = members.select("name").distinct().join(nodes.select("name").distinct(), "name", "left_semi").agg(F.count("*").alias("overlap"))
    total = nodes.agg(F.count_distinct("name").alias("total"))
    fresh = (F.col("overlap") >= least) & (F.col("overlap") >= share * F.col("total"))
    return common.crossJoin(total).select("overlap", "total", (~fresh).alias("stale"))


def top_per_key(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key in an order; Spark prunes per partition before it shuffles."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
