"""Communities: a deterministic partition and its descriptions.

The partition is synchronous label propagation with a fixed number of rounds: a node takes the label
of greatest summed weight among its neighbours and itself, ties to the smallest label. Labels
differ from a seeded modularity search, whose results vary from run to run; descriptions take
any partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.functions.shared import materialize


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 4) -> DataFrame:
    """(name, community). Weights are whole thousandths, so sums do not depend on their order."""
    w = F.greatest(F.round(F.col("weight") * 1000).cast("long"), F.lit(1))
    both = edges.select("src", "dst", w.alias("w")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), w.alias("w")))
    both = both.unionByName(nodes.select(F.col("name").alias("src"), F.col("name").alias("dst"), F.lit(500).cast("long").alias("w")))
    both = materialize(both.groupBy("src", "dst").agg(F.sum("w").alias("w")), "lp-edges")
    state = materialize(nodes.select("name", F.col("name").alias("community")), "lp")
    for _ in range(rounds):
        votes = both.join(state, F.col("dst") == F.col("name")).groupBy("src", "community").agg(F.sum("w").alias("w"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("w")).alias("w"), "community")).alias("b"))
        state = materialize(best.select(F.col("src").alias("name"), F.col("b.community").alias("community")), "lp")
    return state


def modularity(partition: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: modularity of a partition over the undirected weights."""
    named = lambda end: partition.select(F.col("name").alias(end), F.col("community").alias(f"_{end}"))
    e = edges.join(named("src"), "src").join(named("dst"), "dst")
    inner = e.where("_src = _dst").groupBy(F.col("_src").alias("c")).agg(F.sum("weight").alias("l"))
    ends = e.select(F.col("_src").alias("c"), "weight").unionByName(e.select(F.col("_dst").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    m = e.agg(F.sum("weight").alias("m"))
    return ends.join(inner, "c", "left").crossJoin(m).agg(F.sum(F.coalesce("l", F.lit(0.0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), 2)).alias("modularity"))


def describe(partition: DataFrame, nodes: DataFrame, edges: DataFrame, least: int = 2) -> DataFrame:
    """(community, size, dominant_type, internal_edges, hub, relations, summary) of communities of at least ``least`` nodes."""
    kinds = partition.join(nodes.select("name", "entity_type"), "name").groupBy("community", "entity_type").agg(F.count("*").alias("n"))
    shape = kinds.groupBy("community").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("n"), "entity_type")).alias("t"))
    named = lambda end: partition.select(F.col("name").alias(end), F.col("community").alias(f"_{end}"))
    inner = edges.join(named("src"), "src").join(named("dst"), "dst").where("_src = _dst").withColumnRenamed("_src", "community")
    counted = inner.groupBy("community").agg(F.count("*").alias("internal_edges"), F.array_join(F.array_sort(F.collect_set("relation")), ", ").alias("relations"))
    ends = inner.select("community", F.col("src").alias("name")).unionByName(inner.select("community", F.col("dst").alias("name")))
    degree = partition.select("community", "name").join(ends.groupBy("community", "name").agg(F.count("*").alias("d")), ["community", "name"], "left")
    hub = degree.groupBy("community").agg(F.min(F.struct((-F.coalesce("d", F.lit(0))).alias("d"), "name")).alias("h"))
    out = shape.where(F.col("size") >= least).join(counted, "community", "left").join(hub, "community")
    out = out.select(
        "community", "size", F.col("t.entity_type").alias("dominant_type"), F.coalesce("internal_edges", F.lit(0)).alias("internal_edges"),
        F.col("h.name").alias("hub"), F.coalesce("relations", F.lit("various")).alias("relations"),
    )
    # ---- fixed value: the summary sentence
    text = F.format_string(
        "A %s cluster of %d supply chain entities. Central hub: %s. Primary relationship types: %s. Contains %d internal connections.",
        F.lower("dominant_type"), "size", "hub", "relations", "internal_edges",
    )
    return out.withColumn("summary", text)


def community_texts(described: DataFrame, partition: DataFrame, nodes: DataFrame, edges: DataFrame, entities: int = 15, relations: int = 20) -> DataFrame:
    """(community, text): the input of a summariser, with the first names and relations of each community."""
    from riskloom.operators.graph import top_per_key

    first = top_per_key(partition.join(nodes.select("name", "entity_type"), "name"), ["community"], ["name"], entities)
    names = first.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "entity_type"))), lambda x: F.format_string("%s (%s)", x["name"], x["entity_type"])), ", ").alias("names"))
    named = lambda end: partition.select(F.col("name").alias(end), F.col("community").alias(f"_{end}"))
    inner = edges.join(named("src"), "src").join(named("dst"), "dst").where("_src = _dst").select(F.col("_src").alias("community"), "src", "relation", "dst")
    some = top_per_key(inner, ["community"], ["src", "dst"], relations)
    lines = some.groupBy("community").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("src", "dst", "relation"))), lambda x: F.format_string("%s %s %s.", x["src"], x["relation"], x["dst"])), " ").alias("lines"))
    rows = described.join(names, "community").join(lines, "community", "left")
    head = F.format_string("Supply chain community: %s cluster with %d entities. Entities: %s.", "dominant_type", "size", "names")
    return rows.select("community", F.concat(head, F.coalesce(F.concat(F.lit(" Relationships: "), "lines"), F.lit(""))).alias("text"))


def overview(described: DataFrame) -> DataFrame:
    """(community, line): one line a community with the first 90 characters of its summary."""
    return described.select("community", F.format_string("Community %s | %s | %d nodes | %d internal edges | %s", "community", "dominant_type", "size", "internal_edges", F.substr("summary", F.lit(1), F.lit(90))).alias("line"))


def rank_by_keywords(described: DataFrame, members: DataFrame, question: str) -> DataFrame:
    """(community, score): share of the question's words found in the summary or the member names."""
    words = F.array_distinct(F.split(F.lower(F.lit(question)), " "))
    names = members.groupBy("community").agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("names"))
    text = F.lower(F.concat("summary", F.lit(" "), "names"))
    hits = F.size(F.filter(words, lambda w: F.contains(text, w)))
    return described.join(names, "community").select("community", (hits / F.greatest(F.size(words), F.lit(1))).alias("score"))
