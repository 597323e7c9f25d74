"""Disruption propagation: the attenuated bottleneck flow from ground-zero nodes.

A node v takes F(v) = max over in-edges u -> v of min(F(u), capacity) * gamma; among equal
flows the parent of greater flow, fewer hops, then smaller name wins. Only nodes whose own
best path is shorter than ``max_hops`` pass a disruption on, flows under ``prune`` vanish. The
rounds recompute every node from its parents' last state (a value may shrink when a stronger
path turns out to be at the hop limit), and end when nothing changes; flows fall along
every edge, so they do. In large states the later rounds take only nodes behind changed ones. All scenarios and gammas share one state table and one loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from riskloom import schema
from riskloom.functions.shared import materialize, release


#: States of more than ``FEW`` rows follow only changes after so many rounds; by default when all nodes have been reached.
FEW, SPREAD_ROUNDS = 200_000, schema.MAX_HOPS


def severity(score: Column) -> Column:
    out = F.lit(None)
    out = F.when(score >= schema.SEVERITY[0][1], schema.SEVERITY[0][0])
    for name, least in schema.SEVERITY[1:]:
        out = out.when(score >= least, name)
    return out.otherwise("Low")


def capacities(edges: DataFrame) -> DataFrame:
    """(src, dst, relation, cap) of edges that carry a disruption."""
    factor = F.lit(None).cast("double")
    for relation, share in schema.SPREAD.items():
        factor = F.when(F.col("relation") == relation, F.lit(share)).otherwise(factor)
    cap = F.col("weight") * factor
    return edges.where(F.col("relation").isin(*schema.SPREAD)).where("weight <> 0").select("src", "dst", "relation", cap.alias("cap"))


def ground_zero(scenarios: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(scenario, node, shock): named nodes, their places, the affected region, and all that lies there.

    ``scenarios`` has (scenario, ground_zero array, shock, affected_region). A place takes in what is
    located in it; places inside it (regions) are followed on.
    """
    located = materialize(edges.where("relation = 'located_in'").select("src", "dst"), "gz-located")
    regions = nodes.where("entity_type = 'Region'").select(F.col("name").alias("node"))
    named = scenarios.select("scenario", F.explode("ground_zero").alias("node")).distinct()
    here = named.join(located, F.col("node") == F.col("src")).select("scenario", F.col("dst").alias("node"))
    own = scenarios.where("affected_region is not null").select("scenario", F.col("affected_region").alias("node"))
    places = here.unionByName(own).unionByName(named.join(regions, "node", "left_semi").select("scenario", "node"))
    frontier = materialize(places.distinct(), "gz")
    seen, found = frontier, named.unionByName(frontier)
    while not frontier.isEmpty():
        inside = materialize(frontier.join(located, F.col("node") == F.col("dst")).select("scenario", F.col("src").alias("node")).distinct(), "gz")
        found = found.unionByName(inside)
        frontier = materialize(inside.join(regions, "node", "left_semi").join(seen, ["scenario", "node"], "left_anti").select("scenario", "node"), "gz")
        seen = seen.unionByName(frontier)
    valid = found.distinct().join(nodes.select(F.col("name").alias("node")), "node", "left_semi")
    return valid.join(scenarios.select("scenario", "shock"), "scenario").select("scenario", "node", "shock")


def propagate(seeds: DataFrame, edges: DataFrame, gammas: tuple[float, ...] = (schema.GAMMA,), max_hops: int = schema.MAX_HOPS, prune: float = schema.PRUNE, parents: bool = True) -> DataFrame:
    """(scenario, gamma, node, score, hop, and parent if asked for) from seeds (scenario, node, shock)."""
    if not all(0 < g < 1 for g in gammas) or prune <= 0:
        raise ValueError("gamma must lie in (0, 1) and prune above 0")
    gamma = F.explode(F.array(*map(F.lit, gammas))).alias("gamma")
    key = ["node", "scenario", "gamma"]  # names first: sorting meets few equal ones
    zero = seeds.groupBy("scenario", "node").agg(F.max("shock").alias("score")).select("node", "scenario", gamma, "score", F.lit(0).alias("hop"))
    state = materialize(zero, "spread-zero")
    cap = materialize(capacities(edges).select("src", "dst", "cap"), "spread-caps")  # of several edges of a pair the best flow wins below
    # a ground-zero node keeps its own row (z = 0), which comes before any flow into it
    rank = lambda z, flow, score, hop, *parent: F.struct(F.lit(z).alias("z"), (-flow).alias("a"), (-score).alias("b"), hop.alias("c"), *parent)

    def into(state: DataFrame, cap: DataFrame, on: list[str], *parent: Column) -> DataFrame:
        """(node, scenario, gamma, rank) of every flow into a node."""
        flow = F.least("score", "cap") * F.col("gamma")
        sent = cap.join(state.where(F.col("hop") < max_hops).withColumnRenamed("node", "src").hint("shuffle_hash"), on).withColumn("flow", flow)
        sent = sent.where((F.col("flow") >= prune) & (F.col("flow") > 0))
        return sent.select(F.col("dst").alias("node"), "scenario", "gamma", rank(1, F.col("flow"), F.col("score"), F.col("hop"), *parent).alias("r"))

    def settle(flows: DataFrame) -> DataFrame:
        best = flows.groupBy(*key).agg(F.min("r").alias("r"))
        return best.select(*key, (-F.col("r.a")).alias("score"), (F.col("r.c") + 1).alias("hop"))

    def changed(old: DataFrame, new: DataFrame) -> DataFrame:
        """Keys of rows that are not in both."""
        differ = (F.count("*") < 2) | (F.min("score") != F.max("score")) | (F.min("hop") != F.max("hop"))
        return old.unionByName(new).groupBy(*key).agg(differ.alias("differ")).where("differ").select(*key)

    first, before, moved = state, None, None
    kept = first.select(*key, rank(0, F.col("score"), F.col("score"), F.lit(-1)).alias("r"))
    top = seeds.agg(F.max("shock")).first()[0] or 0.0
    rounds = 1 + max(0, math.ceil(math.log(prune / top) / math.log(max(gammas)))) if top > prune else 1
    for done in range(rounds + 1):
        if moved is None:
            new = materialize(settle(kept.unionByName(into(state, cap, ["src"]))), "spread")
            mark = new.agg(F.count("*"), F.sum(F.xxhash64("scenario", "gamma", "node", "score", "hop").cast("decimal(38,0)"))).first()
            if mark != before and done >= SPREAD_ROUNDS and mark[0] > FEW:
                moved = materialize(changed(state, new), "spread-moved")
        else:  # all nodes are reached by now; only what changed nodes flow into can change
            near = cap.join(moved.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "scenario", "gamma").distinct()
            near = materialize(near.join(first, key, "left_anti"), "spread-near")
            again = materialize(settle(into(state, cap.join(near.withColumnRenamed("node", "dst"), "dst"), ["src", "scenario", "gamma"])), "spread-again")
            release(moved)
            moved = materialize(changed(state.join(near, key, "left_semi"), again), "spread-moved")
            mark = before if moved.isEmpty() else None
            new = state if mark else materialize(state.join(near, key, "left_anti").unionByName(again), "spread")
            release(near)
            release(again)
        if state is not first and state is not new:
            release(state)
        state = new
        if mark == before:
            break
        before = mark or before
    if not parents:
        return state.select("scenario", "gamma", "node", "score", "hop")
    # nothing changes any more, so the parents of one more round are those of the state itself
    kept = first.select(*key, rank(0, F.col("score"), F.col("score"), F.lit(-1), F.lit(None).cast("string").alias("d")).alias("r"))
    best = kept.unionByName(into(state, cap, ["src"], F.col("src").alias("d"))).groupBy(*key).agg(F.min("r").alias("r"))
    return materialize(best.select("scenario", "gamma", "node", (-F.col("r.a")).alias("score"), (F.col("r.c") + 1).alias("hop"), F.col("r.d").alias("parent")), "spread")


def with_paths(state: DataFrame, max_hops: int = schema.MAX_HOPS) -> DataFrame:
    """Add ``path``: the node names from a ground-zero node to each node."""
    key = ["scenario", "gamma"]
    done = state.where("hop = 0").withColumn("path", F.array("node"))
    last = done
    for h in range(1, max_hops + 1):
        up = last.select(*key, F.col("node").alias("parent"), F.col("path").alias("head"))
        last = state.where(F.col("hop") == h).join(up, [*key, "parent"]).withColumn("path", F.concat("head", F.array("node"))).select(*done.columns)
        last = materialize(last, "paths")  # else each length would follow all shorter ones anew
        done = done.unionByName(last)
    return done


def exposures(state: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """State with severity, entity type, path and whether an alternative exists."""
    swaps = edges.where("relation = 'alternative_to'").select(F.col("src").alias("node")).distinct().withColumn("has_alternative", F.lit(True))
    kinds = nodes.select(F.col("name").alias("node"), "entity_type")
    out = with_paths(state).join(kinds, "node", "left").join(swaps, "node", "left")
    return out.select(
        "scenario", "gamma", "node", "score", severity(F.col("score")).alias("severity"), "hop",
        F.coalesce("entity_type", F.lit("Unknown")).alias("entity_type"), "path", F.coalesce("has_alternative", F.lit(False)).alias("has_alternative"),
    )


def stats(state: DataFrame) -> DataFrame:
    """Per scenario and gamma: counts by severity and the ranges of scores and hops."""
    s = F.col("score")
    return state.groupBy("scenario", "gamma").agg(
        F.count("*").alias("total_affected"), F.avg("score").alias("mean_score"), F.max("score").alias("max_score"), F.min("score").alias("min_score"),
        F.max("hop").alias("max_hop"), F.count_if(s >= 0.80).alias("critical"), F.count_if((s >= 0.50) & (s < 0.80)).alias("high"),
        F.count_if((s >= 0.25) & (s < 0.50)).alias("moderate"), F.count_if(s < 0.25).alias("low"),
    )
