"""Dual retrieval: vector seeds, hop expansion, fused scores, induced subgraph, context text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom import schema
from riskloom.operators.graph import bfs_distances, degrees, induced_edges


def fuse(distances: DataFrame, seeds: DataFrame, centrality: DataFrame) -> DataFrame:
    """(name, dist, semantic, centrality, score) for all candidates.

    A seed counts with its similarity, any other node with 0.5 per hop; the node's degree
    centrality is added by weight.
    """
    out = distances.join(seeds.select("name", "similarity"), "name", "left").join(centrality.select("name", "centrality"), "name", "left")
    semantic = F.coalesce("similarity", F.pow(F.lit(schema.HOP_DECAY), F.col("dist")))
    score = schema.SEMANTIC_WEIGHT * semantic + schema.DEGREE_WEIGHT * F.coalesce("centrality", F.lit(0.0))
    return out.select("name", "dist", semantic.alias("semantic"), F.coalesce("centrality", F.lit(0.0)).alias("centrality"), score.alias("score"))


def retrieve(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, radius: int = schema.RADIUS, max_nodes: int = schema.MAX_NODES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all scores, kept nodes, induced edges) for seeds (name, similarity)."""
    known = seeds.join(nodes.select("name"), "name", "left_semi")
    scores = fuse(bfs_distances(edges, known, radius), known, degrees(nodes, edges))
    kept = scores.orderBy(F.desc("score"), "name").limit(max_nodes)
    return scores, kept, induced_edges(edges, kept)


def merge_scores(retrieval: DataFrame, disruption: DataFrame) -> DataFrame:
    """(name, retrieval, disruption, merged) of every node that has either; a missing one is 0."""
    both = retrieval.select("name", F.col("score").alias("r")).join(disruption.select("name", F.col("score").alias("d")), "name", "full")
    r, d = F.coalesce("r", F.lit(0.0)), F.coalesce("d", F.lit(0.0))
    return both.select("name", r.alias("retrieval"), d.alias("disruption"), (schema.RETRIEVAL_WEIGHT * r + schema.DISRUPTION_WEIGHT * d).alias("merged"))


def context_lines(kept: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, header, outgoing, incoming): the text block of each kept node."""
    critical = F.when(F.col("weight") >= schema.CRITICAL_EDGE, " [CRITICAL - no alternative]").otherwise("")
    out = edges.select(F.col("src").alias("name"), F.concat(F.lit("  → "), "relation", F.lit(" "), "dst", F.lit(" (weight="), F.format_string("%.2f", "weight"), F.lit(")"), critical).alias("line"))
    into = edges.select(F.col("dst").alias("name"), F.concat(F.lit("  ← "), "relation", F.lit(" "), "src").alias("line"))
    joined = lambda df, name: df.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias(name))
    head = F.concat(F.lit("[NODE] "), "name", F.lit(" | Type: "), F.coalesce("entity_type", F.lit("Unknown")))
    base = kept.select("name").join(nodes.select("name", "entity_type"), "name", "left").select("name", head.alias("header"))
    filled = base.join(joined(out, "outgoing"), "name", "left").join(joined(into, "incoming"), "name", "left")
    return filled.select("name", "header", F.coalesce("outgoing", F.lit("")).alias("outgoing"), F.coalesce("incoming", F.lit("")).alias("incoming"))
