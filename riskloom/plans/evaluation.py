"""Queries on evaluation, communities and reports (A*, M*, F*, P12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import community as m, evaluate as a, report as rp, text as x
from riskloom.plans.base import graph, graph_sql, query
from riskloom.plans.simulation import _sql as spread_sql, spread
from riskloom.sources.fixtures import table

#: Gold and predicted triples from order lines: predictions lose some, turn some, add some.
_GOLD = "SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS seq, concat('doc ', l_orderkey % 40) AS source, concat('S', l_suppkey % 30) AS head, CASE l_returnflag WHEN 'A' THEN 'supplies' WHEN 'N' THEN 'located_in' ELSE 'affected_by' END AS relation, concat('P', l_partkey % 50) AS tail, 'Supplier' AS head_type, CASE WHEN l_partkey % 2 = 0 THEN 'Part' ELSE 'Region' END AS tail_type FROM {t}"
_PRED = "SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS seq, concat(' Doc ', l_orderkey % 40) AS source, CASE WHEN l_partkey % 9 = 0 THEN concat('P', l_partkey % 50) ELSE concat('s', l_suppkey % 30, '.') END AS head, CASE l_returnflag WHEN 'A' THEN 'Supplies' WHEN 'N' THEN 'located in' ELSE 'affected-by' END AS relation, CASE WHEN l_partkey % 9 = 0 THEN concat('S', l_suppkey % 30) WHEN l_partkey % 7 = 0 THEN 'other' ELSE concat('p', l_partkey % 50) END AS tail, 'supplier' AS head_type, 'part' AS tail_type, CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE 'seen' END AS evidence, CASE WHEN l_partkey % 6 = 0 THEN 'high' WHEN l_partkey % 6 = 1 THEN '1.5' ELSE '0.5' END AS confidence FROM {t} WHERE l_tax > 0.01"
_C = r"trim(regexp_replace(lower(trim({0})), '\s+', ' ', 'g'), ' ,;:.')"
_K = f"{_C.format('source')} AS source, {_C.format('head')} AS head, replace(replace({_C.format('relation')}, '-', '_'), ' ', '_') AS relation, {_C.format('tail')} AS tail"
_BASE = f"""gold AS MATERIALIZED ({_GOLD.format(t='lineitem')}), pred AS MATERIALIZED ({_PRED.format(t='lineitem')}),
g AS MATERIALIZED (SELECT DISTINCT {_K} FROM gold), p AS MATERIALIZED (SELECT DISTINCT {_K} FROM pred),
k AS MATERIALIZED (SELECT source, head, relation, tail, g.source IS NOT NULL AS in_gold, p.source IS NOT NULL AS in_pred FROM g FULL JOIN p USING (source, head, relation, tail))"""
_BASE = _BASE.replace("SELECT source, head, relation, tail, g.source IS NOT NULL AS in_gold, p.source IS NOT NULL AS in_pred FROM g FULL JOIN p USING (source, head, relation, tail)",
    "SELECT source, head, relation, tail, bool_or(w = 1) AS in_gold, bool_or(w = 2) AS in_pred FROM (SELECT *, 1 AS w FROM g UNION ALL SELECT *, 2 FROM p) GROUP BY source, head, relation, tail")


def _sql(select: str) -> str:
    return f"WITH {_BASE}\n{select}"


def _pair(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return spark.sql(_GOLD, t=t), spark.sql(_PRED, t=t)


def _prf(by: str) -> str:
    return f"""SELECT {by}gold, pred, tp, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (
SELECT *, CASE WHEN pred = 0 THEN 0 ELSE tp::DOUBLE / pred END AS precision, CASE WHEN gold = 0 THEN 0 ELSE tp::DOUBLE / gold END AS recall FROM (
SELECT {by}count(*) FILTER (in_gold) AS gold, count(*) FILTER (in_pred) AS pred, count(*) FILTER (in_gold AND in_pred) AS tp FROM k {'GROUP BY ' + by.rstrip(', ') if by else ''}))"""


@query("triple_prf", _sql(_prf("")))
def triple_prf(spark, sf_dir):
    """A1, A14, A16."""
    return a.precision_recall(a.matched(*_pair(spark, sf_dir)))


@query("per_relation_recall", _sql(_prf("relation, ")))
def per_relation_recall(spark, sf_dir):
    """A3, A7."""
    return a.precision_recall(a.matched(*_pair(spark, sf_dir)), ["relation"])


@query("per_case_pr", _sql(_prf("source, ") + " WHERE gold > 0"))
def per_case_pr(spark, sf_dir):
    """Per gold source."""
    return a.precision_recall(a.matched(*_pair(spark, sf_dir)), ["source"]).where("gold > 0")


@query("direction_acc", _sql("""SELECT tp, reversed, CASE WHEN tp + reversed = 0 THEN 0 ELSE tp::DOUBLE / (tp + reversed) END AS accuracy FROM (SELECT (SELECT count(*) FROM k WHERE in_gold AND in_pred) AS tp,
(SELECT count(*) FROM k WHERE in_pred AND NOT in_gold AND EXISTS (SELECT 1 FROM g WHERE g.source = k.source AND g.relation = k.relation AND least(g.head, g.tail) = least(k.head, k.tail) AND greatest(g.head, g.tail) = greatest(k.head, k.tail))) AS reversed)"""))
def direction_acc(spark, sf_dir):
    """A2."""
    return a.direction(a.matched(*_pair(spark, sf_dir)))


@query("type_accuracy", _sql(f"""SELECT count(*) AS tp, count(*) FILTER (a.ht = b.ht AND a.tt = b.tt) AS matches, count(*) FILTER (a.ht = b.ht AND a.tt = b.tt)::DOUBLE / count(*) AS accuracy FROM
(SELECT source, head, relation, tail, arg_max(ht, (seq, ht, tt)) AS ht, arg_max(tt, (seq, ht, tt)) AS tt FROM (SELECT {_K}, lower(head_type) AS ht, lower(tail_type) AS tt, seq FROM gold) GROUP BY ALL) a JOIN
(SELECT source, head, relation, tail, arg_max(ht, (seq, ht, tt)) AS ht, arg_max(tt, (seq, ht, tt)) AS tt FROM (SELECT {_K}, lower(head_type) AS ht, lower(tail_type) AS tt, seq FROM pred) GROUP BY ALL) b USING (source, head, relation, tail)"""))
def type_accuracy(spark, sf_dir):
    """A4."""
    return a.type_accuracy(*_pair(spark, sf_dir))


@query("validity_ratios", _sql("SELECT n, with_evidence, valid_confidence, with_evidence::DOUBLE / n AS evidence_share, valid_confidence::DOUBLE / n AS confidence_share FROM (SELECT count(*) AS n, count(*) FILTER (trim(evidence) <> '') AS with_evidence, count(*) FILTER (coalesce(TRY_CAST(confidence AS DOUBLE) BETWEEN 0 AND 1, false)) AS valid_confidence FROM pred)"))
def validity_ratios(spark, sf_dir):
    """A5."""
    return a.validity(_pair(spark, sf_dir)[1])


_WORD = r"regexp_extract(text, '[A-Za-z]{6,}')"


@query("retrieval_coverage", f"SELECT source, count(*) AS expected, count(*) FILTER (hit) AS hit, count(*) FILTER (hit)::DOUBLE / count(*) AS coverage FROM (SELECT DISTINCT source, name, source IN (SELECT source FROM documents d WHERE lower({_WORD}) = name AND n_chars > 1000 AND d.source = t.source) AS hit FROM (SELECT source, lower({_WORD}) AS name FROM documents WHERE {_WORD} <> '') t) GROUP BY source")
def retrieval_coverage(spark, sf_dir):
    """Expected names of each query that were retrieved."""
    d = table(spark, sf_dir, "documents").select("n_chars", "source", F.lower(F.regexp_extract("text", "[A-Za-z]{6,}", 0)).alias("name")).where("name <> ''")
    return a.coverage(d.select("source", "name").distinct(), d.where("n_chars > 1000"), "source")


@query("report_coverage", "SELECT item_id, count(*) FILTER (contains(lower(d.text), lower(b.text))) AS n FROM benchmark b, documents d GROUP BY item_id")
def report_coverage(spark, sf_dir):
    """Documents that contain each stated passage."""
    facts = table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("fact"))
    docs = table(spark, sf_dir, "documents").select(F.lower("text").alias("t"))
    hits = docs.crossJoin(F.broadcast(facts)).where(F.contains("t", F.col("fact"))).groupBy("item_id").agg(F.count("*").alias("n"))  # the suite is fixed
    return facts.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("hit_rate", "SELECT count(*) AS cases, count(*) FILTER (EXISTS (SELECT 1 FROM customer c WHERE contains(lower(c_name), n))) AS hits FROM (SELECT CAST(n_nationkey * 7 AS VARCHAR) AS n FROM nation)")
def hit_rate(spark, sf_dir):
    """Cases of which some retrieved name contains the expected one."""
    cases = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 7).cast("string").alias("n"))
    names = table(spark, sf_dir, "customer").select(F.lower("c_name").alias("name"))
    hits = names.join(F.broadcast(cases), F.contains("name", F.col("n"))).select("n").distinct().agg(F.count("*").alias("hits"))  # the suite is fixed
    return cases.agg(F.count("*").alias("cases")).crossJoin(hits)


@query("weighted_grade", "SELECT source, CASE WHEN s >= 0.85 THEN 'Excellent' WHEN s >= 0.7 THEN 'Good' WHEN s >= 0.5 THEN 'Fair' ELSE 'Poor' END AS grade, s >= 0.7 AS passed FROM (SELECT source, 0.4::DOUBLE * (count(*) FILTER (n_chars > 1000)::DOUBLE / count(*)) + 0.6::DOUBLE * (count(*) FILTER (lang = 'en')::DOUBLE / count(*)) AS s FROM documents GROUP BY source)")
def weighted_grade(spark, sf_dir):
    """Two shares weighted .4 and .6, with grade bands."""
    n = F.count("*")
    s = 0.4 * (F.count_if(F.col("n_chars") > 1000) / n) + 0.6 * (F.count_if(F.col("lang") == "en") / n)
    return table(spark, sf_dir, "documents").groupBy("source").agg(s.alias("s")).select("source", a.grade(F.col("s")).alias("grade"), (F.col("s") >= 0.7).alias("passed"))


@query("scorecard", "SELECT lang AS condition, count(*) AS prompts, sum(quality) AS good, sum(toxic) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def scorecard(spark, sf_dir):
    """Sums per condition."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy(F.col("lang").alias("condition")).agg(F.count("*").alias("prompts"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"))


# ---- communities: nations stand for a given partition
_PART = "part_ AS MATERIALIZED (SELECT src AS name, min(dst) AS community FROM edges WHERE relation = 'located_in' AND dst LIKE 'N:%' GROUP BY src)"


def _partition(edges):
    return edges.where("relation = 'located_in' and dst like 'N:%'").groupBy(F.col("src").alias("name")).agg(F.min("dst").alias("community"))


@query("community_summaries", graph_sql("""SELECT c.community, size, dominant_type, coalesce(internal_edges, 0) AS internal_edges, hub, coalesce(relations, 'various') AS relations,
'A ' || lower(dominant_type) || ' cluster of ' || size || ' supply chain entities. Central hub: ' || hub || '. Primary relationship types: ' || coalesce(relations, 'various') || '. Contains ' || coalesce(internal_edges, 0) || ' internal connections.' AS summary
FROM (SELECT community, sum(n)::BIGINT AS size, arg_min(entity_type, (-n, entity_type)) AS dominant_type FROM (SELECT community, entity_type, count(*) AS n FROM part_ JOIN nodes USING (name) GROUP BY ALL) GROUP BY community) c
LEFT JOIN (SELECT community, count(*) AS internal_edges, string_agg(DISTINCT relation, ', ' ORDER BY relation) AS relations FROM inner_ GROUP BY community) i USING (community)
JOIN (SELECT community, arg_min(name, (-d, name)) AS hub FROM (SELECT p.community, p.name, count(e.name) AS d FROM part_ p LEFT JOIN (SELECT src AS name FROM inner_ UNION ALL SELECT dst FROM inner_) e ON e.name = p.name GROUP BY ALL) GROUP BY community) h USING (community) WHERE size >= 2""",
    _PART, "inner_ AS MATERIALIZED (SELECT e.*, a.community FROM edges e JOIN part_ a ON e.src = a.name JOIN part_ b ON e.dst = b.name WHERE a.community = b.community)"))
def community_summaries(spark, sf_dir):
    """M2, M3, M4: size, dominant type, hub, relations and text of each community."""
    nodes, edges = graph(spark, sf_dir)
    return m.describe(_partition(edges), nodes, edges)


@query("community_partition")
def community_partition(spark, sf_dir):
    """M1: deterministic label propagation."""
    nodes, edges = graph(spark, sf_dir)
    return m.label_propagation(nodes, edges)


@query("community_rank")
def community_rank(spark, sf_dir):
    """M6: communities by the share of a question's words in their text."""
    nodes, edges = graph(spark, sf_dir)
    part = _partition(edges)
    return m.rank_by_keywords(m.describe(part, nodes, edges), part, "which customer cluster depends on s:1")


# ---- events and reports
LIBRARY = {
    "nation_quake": rp.DisruptionEvent("Nation Earthquake", ("N:3",), 0.85, "natural_disaster", "An earthquake strikes factories in one nation"),
    "region_strike": rp.DisruptionEvent("Region Port Strike", ("R:0",), 0.60, "industrial", "A strike closes ports of a whole region"),
    "supplier_fire": rp.DisruptionEvent("Supplier Fire", ("S:1",), 0.90, "industrial", "A fire stops one supplier"),
}


@query("event_detection", """SELECT q AS question, CASE WHEN contains(q, 'strike') THEN 'region_strike' WHEN contains(q, 'fire') THEN 'supplier_fire' ELSE 'nation_quake' END AS scenario FROM (SELECT DISTINCT CASE n_nationkey % 3 WHEN 0 THEN 'what if a port strike hits ' || n_name WHEN 1 THEN 'fire near ' || n_name ELSE 'hello ' || n_name END AS q FROM nation)""")
def event_detection(spark, sf_dir):
    """The event whose words a question names most."""
    n = table(spark, sf_dir, "nation")
    q = F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("what if a port strike hits "), "n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("fire near "), "n_name")).otherwise(F.concat(F.lit("hello "), "n_name"))
    events = rp.events_frame(spark, LIBRARY)
    place = F.create_map(*[F.lit(v) for i, k in enumerate(LIBRARY) for v in (k, i)])
    return rp.detect_event(n.select(q.alias("question")).distinct(), events.withColumn("place", place[F.col("scenario")]))


@query("report_context", spread_sql("SELECT name, merged, line FROM (SELECT f.node AS name, 0.5::DOUBLE * score AS merged, f.node || ' [' || upper(severity) || ']' || CASE WHEN hop > 0 THEN ' via ' || path ELSE '' END || CASE WHEN EXISTS (SELECT 1 FROM edges e WHERE e.src = f.node AND relation = 'alternative_to') THEN ' (alternative available)' ELSE '' END AS line FROM final f JOIN paths p ON f.node = p.node ORDER BY merged DESC, name LIMIT 15)", ("N3",)))
def report_context(spark, sf_dir):
    """the worst nodes with badge, path and alternative."""
    from riskloom.operators import simulate

    nodes, edges, state = spread(spark, sf_dir, ("N3",), parents=True)
    exposed = simulate.exposures(state, nodes, edges).drop("score")
    merged = state.select(F.col("node").alias("name"), (0.5 * F.col("score")).alias("merged"))
    return rp.enriched_context(merged, exposed).select("name", "merged", "line")


@query("report_sections", r"""SELECT item_id, trim(regexp_extract(t, '(?is)## Mitigation Recommendations\n(.*?)\n## ', 1)) AS mitigations, trim(regexp_extract(t, '(?is)## Supply Chain Resilience Assessment\n(.*)$', 1)) AS resilience_assessment FROM (SELECT item_id, '## Mitigation Recommendations' || chr(10) || text || chr(10) || '## Supply Chain Resilience Assessment' || chr(10) || 'HIGH ' || item_id AS t FROM benchmark)""")
def report_sections(spark, sf_dir):
    """Sections of a report text."""
    t = F.concat(F.lit("## Mitigation Recommendations\n"), F.col("text"), F.lit("\n## Supply Chain Resilience Assessment\nHIGH "), F.col("item_id").cast("string"))
    parsed = rp.parse_report(table(spark, sf_dir, "benchmark").select("item_id", t.alias("full_text")))
    return parsed.select("item_id", "mitigations", "resilience_assessment")


@query("api_confidence", "SELECT o_orderkey, CASE WHEN o_totalprice / 500000 >= 0.8 THEN 'HIGH' WHEN o_totalprice / 500000 >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM orders")
def api_confidence(spark, sf_dir):
    """F7."""
    return table(spark, sf_dir, "orders").select("o_orderkey", rp.confidence_of_shock(F.col("o_totalprice") / 500000).alias("confidence"))


@query("wait_seconds", "SELECT n_nationkey, (n_nationkey * 60 + 9.5)::DOUBLE AS s FROM nation")
def wait_seconds(spark, sf_dir):
    """X9."""
    return table(spark, sf_dir, "nation").select("n_nationkey", rp.wait_seconds(F.concat(F.col("n_nationkey").cast("string"), F.lit("m9.5s"))).alias("s"))
