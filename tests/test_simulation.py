"""Propagation against a heap model, the traps, and ground-zero expansion."""

import heapq
import random

import pytest

from riskloom.operators import simulate
from riskloom.operators.report import DisruptionEvent

SPREAD = {"supplies": 1.0, "depends_on": 1.0, "ships_through": 0.7, "located_in": 0.5}


def heap_model(zero, edges, gamma=0.85, max_hops=5, prune=0.03):
    """Best-first search with strict improvement: node -> (flow, hops)."""
    out = {}
    for s, d, r, w in edges:
        if r in SPREAD and w:
            out.setdefault(s, []).append((d, w * SPREAD[r]))
    flow, hops = dict(zero), dict.fromkeys(zero, 0)
    heap = [(-f, 0, n) for n, f in zero.items()]
    heapq.heapify(heap)
    while heap:
        f, h, n = heapq.heappop(heap)
        if -f < flow.get(n, 0) or h >= max_hops:
            continue
        for d, c in out.get(n, []):
            new = min(-f, c) * gamma
            if new >= prune and new > flow.get(d, 0) and d not in zero:
                flow[d], hops[d] = new, h + 1
                heapq.heappush(heap, (-new, h + 1, d))
    return flow, hops


def frames(spark, edges, zero):
    e = spark.createDataFrame(edges, "src string, dst string, relation string, weight double")
    z = spark.createDataFrame([("x", n, f) for n, f in zero.items()], "scenario string, node string, shock double")
    return e, z


@pytest.mark.parametrize("seed", range(4))
def test_same_as_heap(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(14)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(45)}
    edges = [(a, b, rng.choice([*SPREAD, "alternative_to", "connects"]), rng.choice([0.0, 0.25, 0.333, 0.5, 1.0])) for a, b in sorted(pairs) if a != b]
    zero = {"n0": 0.9, "n1": 0.7}
    e, z = frames(spark, edges, zero)
    got = {r["node"]: (r["score"], r["hop"]) for r in simulate.propagate(z, e).collect()}
    flow, hops = heap_model(zero, edges)
    assert got == {n: (flow[n], hops[n]) for n in flow}


def test_hop_cap_binds_the_best_path(spark):
    # a strong long path reaches v at the cap, so w behind it stays clean though a weak short path exists
    chain = [(f"c{i}", f"c{i + 1}", "supplies", 1.0) for i in range(4)]
    edges = [("z", "c0", "supplies", 1.0), *chain, ("z", "c4", "supplies", 0.3), ("c4", "w", "supplies", 1.0)]
    e, z = frames(spark, edges, {"z": 1.0})
    got = {r["node"]: r["hop"] for r in simulate.propagate(z, e).collect()}
    assert got["c4"] == 5 and "w" not in got


def test_paths_and_severity(spark):
    edges = [("a", "b", "supplies", 1.0), ("b", "c", "located_in", 1.0)]
    e, z = frames(spark, edges, {"a": 1.0})
    nodes = spark.createDataFrame([("a", "Supplier"), ("b", "Part")], "name string, entity_type string")
    rows = {r["node"]: r for r in simulate.exposures(simulate.propagate(z, e), nodes, e).collect()}
    assert rows["c"]["path"] == ["a", "b", "c"] and rows["c"]["entity_type"] == "Unknown"
    assert rows["a"]["severity"] == "Critical" and rows["c"]["severity"] == "Moderate"


def test_no_seeds_and_bad_arguments(spark):
    e, z = frames(spark, [("a", "b", "supplies", 1.0)], {"a": 1.0})
    assert simulate.propagate(z.limit(0), e).count() == 0
    with pytest.raises(ValueError):
        simulate.propagate(z, e, gammas=(1.0,))
    with pytest.raises(ValueError):
        DisruptionEvent("x", (), 0.5, "c")


def test_ground_zero_takes_in_places(spark):
    nodes = spark.createDataFrame([("co", "Supplier"), ("R", "Region"), ("sub", "Region"), ("other", "Part"), ("deep", "Part")], "name string, entity_type string")
    edges = spark.createDataFrame([("co", "R", "located_in", 1.0), ("other", "R", "located_in", 1.0), ("sub", "R", "located_in", 1.0), ("deep", "sub", "located_in", 1.0), ("R", "sub", "located_in", 1.0)], "src string, dst string, relation string, weight double")
    sc = spark.createDataFrame([("s", ["co", "missing"], 0.5, None)], "scenario string, ground_zero array<string>, shock double, affected_region string")
    got = {r["node"] for r in simulate.ground_zero(sc, nodes, edges).collect()}
    assert got == {"co", "R", "sub", "other", "deep"}


@pytest.mark.parametrize("seed", range(3))
def test_following_changes_alone_gives_the_same(spark, seed, monkeypatch):
    rng = random.Random(10 + seed)
    names = [f"n{i}" for i in range(40)]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(140)})
    edges = [(a, b, rng.choice([*SPREAD, "alternative_to"]), rng.choice([0.25, 0.333, 0.5, 1.0])) for a, b in pairs if a != b]
    # a strong long path to the hop limit, found after a weak short one, takes back what lay behind
    edges += [("n0", "c0", "supplies", 1.0), *[(f"c{i}", f"c{i + 1}", "supplies", 1.0) for i in range(4)], ("n0", "c4", "supplies", 0.3), ("c4", "w", "supplies", 1.0), ("w", "n1", "supplies", 1.0)]
    e, z = frames(spark, edges, {"n0": 1.0, "n2": 0.7})
    every = simulate.propagate(z, e, (0.7, 0.85))
    want = sorted((r["gamma"], r["node"], r["score"], r["hop"], r["parent"] or "") for r in every.collect())
    flow, hops = heap_model({"n0": 1.0, "n2": 0.7}, edges)
    assert {n: (s, h) for g, n, s, h, _ in want if g == 0.85} == {n: (flow[n], hops[n]) for n in flow}
    monkeypatch.setattr(simulate, "FEW", 0)
    for hops_before in (5, 1):  # changes are followed from an early round on, too
        monkeypatch.setattr(simulate, "SPREAD_ROUNDS", hops_before)
        some = simulate.propagate(z, e, (0.7, 0.85))
        assert sorted((r["gamma"], r["node"], r["score"], r["hop"], r["parent"] or "") for r in some.collect()) == want
    assert simulate.propagate(z, e, (0.85,), parents=False).columns == ["scenario", "gamma", "node", "score", "hop"]
