"""Queries on vectors and retrieval (V*, Q*, E2, F1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import retrieve as r, vectors as v
from riskloom.operators.graph import bfs_distances, degrees, induced_edges
from riskloom.plans.base import graph, graph_sql, query
from riskloom.plans.simulation import _sql as spread_sql, spread
from riskloom.sources.fixtures import table

_DOT = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


def _index(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _queries(spark, sf_dir, where):
    return _index(spark, sf_dir).where(where).select(F.col("id").alias("query"), F.col("vector").alias("qvec"))


def _top_sql(where: str, k: int, extra: str = "true") -> str:
    return f"""SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rn FROM (
SELECT q.vec_id AS query, e.vec_id AS id, {_DOT} AS score FROM embeddings e, embeddings q WHERE {where}) WHERE {extra}) WHERE rn <= {k}"""


@query("topk_ip", _top_sql("q.vec_id = 7", 10))
def topk_ip(spark, sf_dir):
    """V3: exact top-10 inner product of one query."""
    return v.search(_index(spark, sf_dir).select("id", "vector"), _queries(spark, sf_dir, "id = 7"), 10)


@query("batch_topk", _top_sql("q.vec_id % 100 = 0", 5))
def batch_topk(spark, sf_dir):
    """V4: top-5 of a batch of queries."""
    return v.search(_index(spark, sf_dir).select("id", "vector"), _queries(spark, sf_dir, "id % 100 = 0"), 5)


@query("filtered_search", _top_sql("q.vec_id % 100 = 0 AND e.label = 2", 5, "score >= 0.05"))
def filtered_search(spark, sf_dir):
    """V7, V8: search within one type and above a threshold."""
    return v.search(_index(spark, sf_dir).where("label = 2").select("id", "vector"), _queries(spark, sf_dir, "id % 100 = 0"), 5, 0.05)


@query("cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id + 20 = b.vec_id")
def cosine_pairs(spark, sf_dir):
    """V5."""
    a = _index(spark, sf_dir).select(F.col("id").alias("a"), F.col("vector").alias("va"), "label")
    b = _index(spark, sf_dir).select((F.col("id") - 20).alias("a"), F.col("id").alias("b"), F.col("vector").alias("vb"), "label")
    return a.join(b, ["a", "label"]).select("a", "b", v.cosine(F.col("va"), F.col("vb")).alias("sim"))


@query("cache_hits", _top_sql("q.vec_id % 100 = 0", 1, "score >= 0.92"))
def cache_hits(spark, sf_dir):
    """Best cached entry of each query, if near enough."""
    best = v.search(_index(spark, sf_dir).select("id", "vector"), _queries(spark, sf_dir, "id % 100 = 0"), 1)
    return best.where("score >= 0.92")


@query("prototype_route", """WITH flat AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE label IN (0, 1)),
p AS (SELECT label, list(x ORDER BY i) AS vec FROM (SELECT label, i, round(avg(x), 6) AS x FROM flat GROUP BY label, i) GROUP BY label)
SELECT vec_id AS id, list_dot_product(embedding::DOUBLE[], (SELECT vec FROM p WHERE label = 0)) > list_dot_product(embedding::DOUBLE[], (SELECT vec FROM p WHERE label = 1)) AS is_global FROM embeddings""")
def prototype_route(spark, sf_dir):
    """Nearer to the global or the local prototype (means rounded so that summation order does not matter)."""
    idx = _index(spark, sf_dir)
    p = v.prototypes(idx.where("label in (0, 1)").select("label", "vector"))
    p = p.select("label", F.transform("vector", lambda x: F.round(x, 6)).alias("vector")).groupBy().pivot("label", [0, 1]).agg(F.first("vector")).toDF("g", "l")
    return idx.crossJoin(F.broadcast(p)).select("id", (v.dot(F.col("vector"), F.col("g")) > v.dot(F.col("vector"), F.col("l"))).alias("is_global"))


_LEAD = f"""items AS (SELECT vec_id AS id, vec_id AS place, label, embedding FROM embeddings),
pairs AS MATERIALIZED (SELECT a.id AS first, b.id AS then_id FROM items a JOIN items b ON a.label = b.label AND a.id < b.id WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3),
l0 AS MATERIALIZED (SELECT id FROM items)"""
_LEADS = ",\n".join(f"l{i} AS MATERIALIZED (SELECT id FROM items WHERE id NOT IN (SELECT then_id FROM pairs WHERE first IN (SELECT id FROM l{i - 1})))" for i in range(1, 31))


@query("leader_clusters", f"WITH {_LEAD},\n{_LEADS}\nSELECT id, CASE WHEN id IN (SELECT id FROM l30) THEN id ELSE (SELECT min(first) FROM pairs WHERE then_id = items.id AND first IN (SELECT id FROM l30)) END AS leader FROM items")
def leader_clusters(spark, sf_dir):
    """Greedy leader clustering by cosine (unit vectors) within each type, in id order."""
    items = _index(spark, sf_dir).select("id", "vector", "label", F.col("id").alias("place"))
    return v.leader_search(items, 0.3, "label")


# ---- retrieval on the supply graph: parts stand for vectors by their number
_SEEDS = f"""seeds AS MATERIALIZED (SELECT 'P:' || id AS name, score AS similarity FROM ({_top_sql("q.vec_id = 11 AND e.vec_id > 0 AND e.vec_id <> q.vec_id", 5, "score >= 0.2")}) WHERE 'P:' || id IN (SELECT name FROM nodes))"""
_HOPS = """sym AS MATERIALIZED (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
h0 AS MATERIALIZED (SELECT DISTINCT name, 0 AS dist FROM seeds), h1 AS MATERIALIZED (SELECT DISTINCT dst AS name, 1 AS dist FROM sym JOIN h0 ON src = name WHERE dst NOT IN (SELECT name FROM h0)),
h2 AS MATERIALIZED (SELECT DISTINCT dst AS name, 2 AS dist FROM sym JOIN h1 ON src = name WHERE dst NOT IN (SELECT name FROM h0 UNION SELECT name FROM h1)),
near AS MATERIALIZED (SELECT * FROM h0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2),
deg AS MATERIALIZED (SELECT name, count(node)::DOUBLE / ((SELECT count(*) FROM nodes) - 1) AS centrality FROM nodes LEFT JOIN (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) ON name = node GROUP BY name),
scored AS MATERIALIZED (SELECT n.name, dist, coalesce(similarity, pow(0.5::DOUBLE, dist)) AS semantic, centrality, 0.6::DOUBLE * coalesce(similarity, pow(0.5::DOUBLE, dist)) + 0.4::DOUBLE * centrality AS score FROM near n LEFT JOIN seeds s ON n.name = s.name JOIN deg d ON n.name = d.name),
kept AS MATERIALIZED (SELECT * FROM scored ORDER BY score DESC, name LIMIT 40),
sub AS MATERIALIZED (SELECT * FROM edges WHERE src IN (SELECT name FROM kept) AND dst IN (SELECT name FROM kept))"""


def _seeds(spark, sf_dir):
    idx = _index(spark, sf_dir).select("id", "vector").where("id > 0 and id <> 11")
    hits = v.search(idx, _queries(spark, sf_dir, "id = 11"), 5, 0.2)
    return hits.select(F.concat(F.lit("P:"), F.col("id").cast("string")).alias("name"), F.col("score").alias("similarity"))


def _retrieved(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    return nodes, edges, *r.retrieve(nodes, edges, _seeds(spark, sf_dir))


@query("seeds", graph_sql("SELECT name, similarity FROM seeds", _SEEDS))
def seeds(spark, sf_dir):
    """Q1: similar enough and in the graph."""
    return _seeds(spark, sf_dir).join(graph(spark, sf_dir)[0].select("name"), "name", "left_semi")


@query("khop", graph_sql("SELECT DISTINCT name FROM near", _SEEDS, _HOPS))
def khop(spark, sf_dir):
    """Q2: union of the seeds' two-hop neighbourhoods."""
    nodes, edges = graph(spark, sf_dir)
    return bfs_distances(edges, _seeds(spark, sf_dir).join(nodes, "name", "left_semi"), 2).select("name")


@query("bfs_dist", graph_sql("SELECT name, dist FROM near", _SEEDS, _HOPS))
def bfs_dist(spark, sf_dir):
    """Q3: hops from the nearest seed."""
    nodes, edges = graph(spark, sf_dir)
    return bfs_distances(edges, _seeds(spark, sf_dir).join(nodes, "name", "left_semi"), 2)


@query("fusion", graph_sql("SELECT * FROM scored", _SEEDS, _HOPS))
def fusion(spark, sf_dir):
    """Q4."""
    return _retrieved(spark, sf_dir)[2]


@query("trimmed_nodes", graph_sql("SELECT name, score FROM kept", _SEEDS, _HOPS))
def trimmed_nodes(spark, sf_dir):
    """Q5: the 40 best."""
    return _retrieved(spark, sf_dir)[3].select("name", "score")


@query("induced_subgraph", graph_sql("SELECT src, dst, relation, weight FROM sub", _SEEDS, _HOPS))
def induced_subgraph(spark, sf_dir):
    """Q5."""
    return _retrieved(spark, sf_dir)[4]


@query("retrieval_stats", graph_sql("SELECT (SELECT count(*) FROM seeds) AS seeds, (SELECT count(*) FROM near) AS candidates, (SELECT count(*) FROM kept) AS kept, (SELECT count(*) FROM sub) AS edges", _SEEDS, _HOPS))
def retrieval_stats(spark, sf_dir):
    """Q6."""
    _, _, scores, kept, sub = _retrieved(spark, sf_dir)
    one = lambda df, c, name: df.agg(F.count(c).alias(name))
    head = scores.agg(F.count_if(F.col("dist") == 0).alias("seeds"), F.count("*").alias("candidates"))
    return head.crossJoin(one(kept, "*", "kept")).crossJoin(one(sub, "*", "edges"))  # one row each


@query("context_lines", graph_sql("""SELECT k.name, '[NODE] ' || k.name || ' | Type: ' || entity_type AS header,
coalesce((SELECT string_agg(line, chr(10) ORDER BY line) FROM (SELECT '  → ' || relation || ' ' || dst || ' (weight=' || printf('%.2f', weight) || ')' || CASE WHEN weight >= 0.95 THEN ' [CRITICAL - no alternative]' ELSE '' END AS line FROM sub WHERE src = k.name)), '') AS outgoing,
coalesce((SELECT string_agg(line, chr(10) ORDER BY line) FROM (SELECT '  ← ' || relation || ' ' || src AS line FROM sub WHERE dst = k.name)), '') AS incoming FROM kept k JOIN nodes n ON n.name = k.name""", _SEEDS, _HOPS))
def context_lines(spark, sf_dir):
    """Q7: context text blocks."""
    nodes, _, _, kept, sub = _retrieved(spark, sf_dir)
    return r.context_lines(kept, nodes, sub)


@query("context_quality", graph_sql("SELECT count(*) AS lines, count(*) FILTER (weight >= 0.95) AS critical FROM sub", _SEEDS, _HOPS))
def context_quality(spark, sf_dir):
    """Q10: arrows and CRITICAL marks in the context."""
    nodes, _, _, kept, sub = _retrieved(spark, sf_dir)
    text = F.col("outgoing")
    return r.context_lines(kept, nodes, sub).agg(F.sum(F.regexp_count(text, F.lit("→"))).alias("lines"), F.sum(F.regexp_count(text, F.lit("CRITICAL"))).alias("critical"))


@query("vector_baseline", graph_sql(f"SELECT name, entity_type, score FROM ({_top_sql('q.vec_id = 11 AND e.vec_id > 0', 8)}) JOIN nodes ON name = 'P:' || id"))
def vector_baseline(spark, sf_dir):
    """Q9: the vector-only baseline, top 8 with types."""
    nodes, _ = graph(spark, sf_dir)
    hits = v.search(_index(spark, sf_dir).select("id", "vector").where("id > 0"), _queries(spark, sf_dir, "id = 11"), 8)
    return hits.withColumn("name", F.concat(F.lit("P:"), F.col("id").cast("string"))).join(nodes, "name").select("name", "entity_type", "score")


@query("merge_scores", spread_sql("SELECT coalesce(s.name, f.node) AS name, coalesce(s.score, 0) AS retrieval, coalesce(f.score, 0) AS disruption, 0.5::DOUBLE * coalesce(s.score, 0) + 0.5::DOUBLE * coalesce(f.score, 0) AS merged FROM scored s FULL JOIN final f ON s.name = f.node", ("N3",)).replace("\nSELECT coalesce", f",\n{_SEEDS},\n{_HOPS}\nSELECT coalesce"))
def merge_scores(spark, sf_dir):
    """F1: full outer merge of retrieval and disruption scores."""
    nodes, edges, scores, _, _ = _retrieved(spark, sf_dir)
    state = spread(spark, sf_dir, ("N3",), known=(nodes, edges))[2]
    return r.merge_scores(scores, state.select(F.col("node").alias("name"), "score"))


@query("ego_subgraph", graph_sql("SELECT e.src, e.dst, e.relation FROM edges e WHERE src IN (SELECT name FROM near) AND dst IN (SELECT name FROM near)", "seeds AS (SELECT 'S:1' AS name)", _HOPS.split(",\ndeg AS")[0]))
def ego_subgraph(spark, sf_dir):
    """The induced two-hop neighbourhood of one node."""
    _, edges = graph(spark, sf_dir)
    seed = spark.range(1).select(F.lit("S:1").alias("name"))
    return induced_edges(edges, bfs_distances(edges, seed, 2)).select("src", "dst", "relation")


@query("node_texts", graph_sql("SELECT name, entity_type || ': ' || name || coalesce('. Evidence: ' || array_to_string(list(e ORDER BY e)[1:2], ' '), '') AS txt FROM nodes LEFT JOIN (SELECT DISTINCT src, relation || ' ' || dst AS e FROM edges) ON src = name GROUP BY name, entity_type"))
def node_texts(spark, sf_dir):
    """V1: text of a node with its first two evidences."""
    nodes, edges = graph(spark, sf_dir)
    ev = edges.select(F.col("src").alias("name"), F.concat_ws(" ", "relation", "dst").alias("e")).distinct()
    first = ev.groupBy("name").agg(F.array_join(F.slice(F.sort_array(F.collect_list("e")), 1, 2), " ").alias("ev"))
    text = F.concat("entity_type", F.lit(": "), "name", F.coalesce(F.concat(F.lit(". Evidence: "), "ev"), F.lit("")))
    return nodes.join(first, "name", "left").select("name", text.alias("txt"))
