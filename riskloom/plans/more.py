"""Queries on extraction, descriptions, routing and orchestration."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import analyze as an, community, extract as ex, report as rp, resolve, text as x, vectors as v
from riskloom.operators.graph import degrees, top_per_key
from riskloom.plans.base import graph, graph_sql, query
from riskloom.plans.evaluation import LIBRARY, _partition
from riskloom.plans.retrieval import _index, _seeds
from riskloom.plans.text import _COUNT
from riskloom.sources.fixtures import table

_STRONG, _SECOND, _MONEY = ["licensed", "idiot"], ["the ", "that", "que ", "der "], ["and", "para"]
_HIT = "len(list_filter({0}, lambda w: contains(lower(text), w)))"


@query("keep_turns", f"SELECT conv_id, turn FROM conversations WHERE {_COUNT.format(c='text')} >= 20 AND ({_HIT.format(_STRONG)} > 0 OR ({_HIT.format(_SECOND)} >= 2 AND NOT ({_HIT.format(_MONEY)} > 0 AND {_HIT.format(_STRONG)} = 0 AND {_HIT.format(_SECOND)} < 2)))")
def keep_turns(spark, sf_dir):
    """Strong keywords, or two secondary ones unless only finance is meant."""
    return table(spark, sf_dir, "conversations").where(ex.keep_turn(F.col("text"), _STRONG, _SECOND, _MONEY)).select("conv_id", "turn")


@query("clean_records", f"SELECT conv_id, count(*) AS turns, sum({_COUNT.format(c='text')})::BIGINT AS words, md5(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE role <> 'system' GROUP BY conv_id")
def clean_records(spark, sf_dir):
    """Text of the kept turns, blank-line joined, with counts; empty records go."""
    kept = table(spark, sf_dir, "conversations").where("role <> 'system'")
    rows = kept.groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(x.word_count(F.col("text"))).alias("words"), F.sort_array(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("s")))).alias("r"))
    return rows.select("conv_id", "turns", "words", F.md5(F.array_join(F.transform("r", lambda e: e["s"]), "\n\n").cast("binary")).alias("digest"))


@query("fallback_groups", r"SELECT key, entity_type, count(*) AS n, min(name) AS least FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Supplier' ELSE 'Port' END AS entity_type, s_name AS name, trim(regexp_replace(regexp_replace(lower(s_name || ' É!'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS key FROM supplier) GROUP BY key, entity_type")
def fallback_groups(spark, sf_dir):
    """Groups by type and punctuation-free key, accents kept."""
    s = table(spark, sf_dir, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, "Supplier").otherwise("Port").alias("entity_type"), F.col("s_name").alias("name"), resolve.entity_key(F.concat("s_name", F.lit(" É!"))).alias("key"))
    return s.groupBy("key", "entity_type").agg(F.count("*").alias("n"), F.min("name").alias("least"))


@query("name_batches", graph_sql("SELECT entity_type, batch, count(*) AS n, min(name) AS first, max(name) AS last FROM (SELECT entity_type, name, (row_number() OVER (PARTITION BY entity_type ORDER BY name) - 1) // 200 AS batch FROM nodes) GROUP BY entity_type, batch"))
def name_batches(spark, sf_dir):
    """Names in batches of 200 per type for a canonicaliser."""
    b = ex.name_batches(graph(spark, sf_dir)[0])
    return b.select("entity_type", "batch", F.size("names").cast("long").alias("n"), F.array_min("names").alias("first"), F.array_max("names").alias("last"))


@query("entity_descriptions", graph_sql("SELECT name, entity_type || ' ' || label || ' (' || coalesce((SELECT string_agg(DISTINCT relation, ', ' ORDER BY relation) FROM edges WHERE src = name), 'no relations') || ')' AS description FROM nodes"))
def entity_descriptions(spark, sf_dir):
    """V6: one description per entity for the vector store."""
    nodes, edges = graph(spark, sf_dir)
    rel = edges.groupBy(F.col("src").alias("name")).agg(F.array_join(F.array_sort(F.collect_set("relation")), ", ").alias("r"))
    return nodes.join(rel, "name", "left").select("name", F.concat("entity_type", F.lit(" "), "label", F.lit(" ("), F.coalesce("r", F.lit("no relations")), F.lit(")")).alias("description"))


@query("ground_zero_names", """WITH q AS (SELECT 'v' || CASE WHEN vec_id % 200 = 0 THEN vec_id ELSE vec_id + 1000000 END AS name, vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0)
SELECT q.name, CASE WHEN q.vec_id % 200 = 0 THEN q.name ELSE (SELECT 'v' || e.vec_id FROM embeddings e WHERE e.vec_id <> q.vec_id ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, 'v' || e.vec_id LIMIT 1) END AS node, q.vec_id % 200 = 0 AS exact FROM q""")
def ground_zero_names(spark, sf_dir):
    """V9: named nodes as they are, others by the nearest vector."""
    idx = _index(spark, sf_dir)
    own = F.concat(F.lit("v"), F.col("id").cast("string"))
    q = idx.where("id % 100 = 0").select(F.concat(F.lit("v"), F.when(F.col("id") % 200 == 0, F.col("id")).otherwise(F.col("id") + 1000000).cast("string")).alias("query"), F.col("vector").alias("qvec"), F.col("id").alias("own"), own.alias("but"))
    nodes = idx.select(own.alias("name"))
    # a query's own vector stands under another name, so it is left out of its own search
    best = v.search(idx.select(own.alias("id"), "vector"), q.where("own % 200 <> 0").select("query", "qvec", "but"), 1)
    out = q.select(F.col("query").alias("name")).join(nodes.withColumn("node", F.col("name")), "name", "left").join(best.select(F.col("query").alias("name"), F.col("id").alias("near")), "name", "left")
    return out.select("name", F.coalesce("node", "near").alias("node"), F.col("node").isNotNull().alias("exact"))


@query("global_route")
def global_route(spark, sf_dir):
    """Q8, M8: the three communities nearest to a question, by keywords, as text in front of a context."""
    nodes, edges = graph(spark, sf_dir)
    part = _partition(edges)
    about = community.describe(part, nodes, edges)
    ranked = community.rank_by_keywords(about, part, "customer cluster hub s:1 supplies").orderBy(F.desc("score"), "community").limit(3)
    return ranked.join(about, "community").select("community", "score", "summary")


@query("community_semantic_rank")
def community_semantic_rank(spark, sf_dir):
    """M7: communities by similarity of their summaries to a question, with the offline embedder."""
    nodes, edges = graph(spark, sf_dir)
    about = rp.embed_texts(community.describe(_partition(edges), nodes, edges).select("community", "summary"), "summary")
    q = rp.embed_texts(spark.range(1).select(F.lit("manufacturer cluster").alias("query")), "query", "qvec")
    return v.search(about.select(F.col("community").alias("id"), "vector"), q.select("query", "qvec"), 3)


@query("extract_triples")
def extract_triples(spark, sf_dir):
    """The offline extractor over whole texts."""
    return ex.extract_triples(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("ablation_table")
def ablation_table(spark, sf_dir):
    """A10: coverage of expected names without context, with the nearest nodes alone, and by the full pipeline (offline writer)."""
    nodes, edges = graph(spark, sf_dir)
    return an.ablation(LIBRARY["nation_quake"], "which nodes does a quake in N:3 expose", ["N:3", "S:7", "P:1"], nodes, edges, _seeds(spark, sf_dir))


@query("benchmark_summary", "SELECT 'documents' AS metric, count(*) AS n FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'labels', count(*) FROM labels")
def benchmark_summary(spark, sf_dir):
    """One row per metric."""
    one = lambda t: table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("metric"), "n")
    return one("documents").unionByName(one("benchmark")).unionByName(one("labels"))


@query("impact_context", graph_sql("SELECT relation || ' ' || src || ' ' || dst AS line, row_number() OVER (ORDER BY relation, src, dst) AS place FROM (SELECT DISTINCT relation, src, dst FROM edges WHERE src = 'S:7' OR dst = 'S:7') ORDER BY place LIMIT 15"))
def impact_context(spark, sf_dir):
    """De-duplicated context lines of one company (a report of 15 lines)."""
    from pyspark.sql.window import Window

    _, edges = graph(spark, sf_dir)
    mine = edges.where("src = 'S:7' or dst = 'S:7'").select("relation", "src", "dst").distinct()
    top = mine.orderBy("relation", "src", "dst").limit(15)
    return top.select(F.concat_ws(" ", "relation", "src", "dst").alias("line"), F.row_number().over(Window.orderBy("relation", "src", "dst")).cast("long").alias("place"))  # 15 rows


@query("plot_sample", graph_sql("SELECT entity_type, name, degree FROM (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY degree DESC, name) AS rn FROM (SELECT entity_type, name, count(node) AS degree FROM nodes LEFT JOIN (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) ON name = node GROUP BY entity_type, name)) WHERE rn <= 70"))
def plot_sample(spark, sf_dir):
    """The 70 best connected nodes of each type (a sampling operator)."""
    nodes, edges = graph(spark, sf_dir)
    ranked = nodes.select("entity_type", "name").join(degrees(nodes, edges).select("name", "degree"), "name")
    return top_per_key(ranked, ["entity_type"], [F.desc("degree"), "name"], 70).select("entity_type", "name", "degree")


@query("analyze_report")
def analyze_report(spark, sf_dir):
    """From an event and question seeds to a parsed report, with the offline writer."""
    nodes, edges = graph(spark, sf_dir)
    out = an.analyze(LIBRARY["nation_quake"], nodes, edges, _seeds(spark, sf_dir))
    return rp.parse_report(spark.createDataFrame([(out.text,)], "full_text string"))
