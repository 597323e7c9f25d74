"""Queries on triples and graph construction (R*, G*, K3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskloom.functions.shared import materialize
from riskloom.operators import graph as g, triples as t
from riskloom.plans.base import graph, graph_sql, query
from riskloom.sources.fixtures import raw_edges, table

#: Triples with noise: case variants, marks, synonyms, self-loops, bad confidences.
_RAW = """SELECT ({big}(l_orderkey) * 10 + l_linenumber) * 100000000 + l_partkey * 1000 + l_suppkey % 1000 AS seq, CAST({big}(l_orderkey) % 50 AS BIGINT) AS chunk,
  CASE WHEN l_linenumber % 3 = 0 THEN concat(' SUPPLIER  ', l_suppkey % 40, ';') ELSE concat('Supplier ', l_suppkey % 40) END AS head,
  CASE l_returnflag WHEN 'A' THEN 'supplier' WHEN 'N' THEN 'City' ELSE 'War' END AS head_type,
  CASE l_linenumber WHEN 1 THEN 'Supplies' WHEN 2 THEN 'depends-on' WHEN 3 THEN 'located in' WHEN 4 THEN 'affected_by' WHEN 5 THEN 'alternative_to' ELSE 'unknown' END AS relation,
  CASE WHEN l_linenumber = 5 THEN concat('Supplier ', (l_suppkey + l_partkey) % 40) WHEN l_partkey % 11 = 0 THEN concat('supplier ', l_suppkey % 40, '.') ELSE concat('Place ', l_partkey % 60) END AS tail,
  CASE l_linestatus WHEN 'O' THEN 'Region' ELSE CASE WHEN l_partkey % 5 = 0 THEN 'event' ELSE 'Part' END END AS tail_type,
  CASE WHEN l_partkey % 7 = 0 THEN 'n/a' ELSE CAST({big}(l_quantity) AS {text}) END AS confidence
FROM lineitem"""
_RAW_DUCK = _RAW.format(big="bigint_", text="VARCHAR").replace("bigint_(l_orderkey)", "CAST(l_orderkey AS BIGINT)").replace("bigint_(l_quantity)", "CAST(l_quantity AS BIGINT)")
_WORDS = " ".join(f"WHEN '{w}' THEN '{k}'" for w, k in t.TYPE_WORDS.items())
_NAME = r"trim(regexp_replace({c}, '\s+', ' ', 'g'), ' ,;:.')"
_TYPE = "CASE lower(replace(" + _NAME + ", ' ', '')) " + _WORDS + " ELSE " + _NAME + " END"
_ENT = ", ".join(map(repr, ("Supplier", "Manufacturer", "Part", "Port", "Region", "LogisticsRoute", "DisruptionEvent", "Customer")))
_REL = ", ".join(map(repr, ("supplies", "depends_on", "ships_through", "located_in", "affected_by", "alternative_to", "sells_to", "connects")))
_NORM = f"""raw AS MATERIALIZED ({_RAW_DUCK}),
norm AS MATERIALIZED (SELECT seq, chunk, {_NAME.format(c='head')} AS head, {_TYPE.format(c='head_type')} AS head_type,
  replace(replace(lower({_NAME.format(c='relation')}), '-', '_'), ' ', '_') AS relation, {_NAME.format(c='tail')} AS tail, {_TYPE.format(c='tail_type')} AS tail_type,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(TRY_CAST(confidence AS DOUBLE) , 0.7))) AS confidence FROM raw),
good AS MATERIALIZED (SELECT * FROM norm WHERE head <> '' AND tail <> '' AND lower(head) <> lower(tail) AND relation IN ({_REL}) AND head_type IN ({_ENT}) AND tail_type IN ({_ENT}))"""


def _sql(select: str, *more: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([_NORM, *more]) + "\n" + select


def _raw(spark, sf_dir) -> DataFrame:
    sql = _RAW.format(big="bigint", text="STRING").replace("FROM lineitem", "FROM {lines}")
    return spark.sql(sql, lines=table(spark, sf_dir, "lineitem"))


def _good(spark, sf_dir) -> DataFrame:
    """Valid triples; normalised once, since filters below would evaluate the expressions again."""
    return t.valid(materialize(t.normalize(_raw(spark, sf_dir)), "triples"))


@query("normalize_triples", _sql("SELECT * FROM norm"))
def normalize_triples(spark, sf_dir):
    """Names, relations, types and confidences made uniform."""
    return t.normalize(_raw(spark, sf_dir))


@query("validate_triples", _sql("SELECT * FROM good"))
def validate_triples(spark, sf_dir):
    """R1."""
    return _good(spark, sf_dir)


@query("dedupe_chunk_first", _sql("SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY chunk, lower(head), relation, lower(tail) ORDER BY seq, chunk, head, head_type, relation, tail, tail_type, confidence) AS rn FROM good) WHERE rn = 1"))
def dedupe_chunk_first(spark, sf_dir):
    """R2."""
    return t.dedupe_first(_good(spark, sf_dir), ["chunk"])


_BEST = "best AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY lower(head), relation, lower(tail) ORDER BY confidence DESC, seq, chunk, head, head_type, relation, tail, tail_type) AS rn FROM good) WHERE rn = 1)"


@query("dedupe_max_conf", _sql("SELECT * FROM best", _BEST))
def dedupe_max_conf(spark, sf_dir):
    """R3."""
    return t.merge_best(_good(spark, sf_dir))


_SWAP = "seq, chunk, tail AS head, tail_type AS head_type, relation, head AS tail, head_type AS tail_type, confidence"
_IS = "relation = 'located_in'"


@query("flip_located_in", _sql(f"""SELECT * FROM good WHERE NOT ({_IS} AND tail_type = 'Region' AND head_type NOT IN ('Region', 'DisruptionEvent')) AND NOT ({_IS} AND tail_type = 'DisruptionEvent' AND head_type = 'Region')
UNION ALL SELECT {_SWAP} FROM good WHERE {_IS} AND ((tail_type = 'Region' AND head_type <> 'DisruptionEvent') OR (tail_type = 'DisruptionEvent' AND head_type = 'Region'))"""))
def flip_located_in(spark, sf_dir):
    """Six cases; two regions give both directions."""
    return t.direct_located_in(_good(spark, sf_dir))


@query("flip_affected_by", _sql(f"""SELECT * FROM good WHERE NOT (relation = 'affected_by' AND tail_type = 'DisruptionEvent' AND head_type <> 'DisruptionEvent')
UNION ALL SELECT {_SWAP} FROM good WHERE relation = 'affected_by' AND tail_type = 'DisruptionEvent' AND head_type <> 'DisruptionEvent'"""))
def flip_affected_by(spark, sf_dir):
    """R5."""
    return t.direct_affected_by(_good(spark, sf_dir))


@query("canon_rewrite", _sql("""SELECT seq, coalesce(a.canonical, head) AS head, relation, coalesce(b.canonical, tail) AS tail FROM best LEFT JOIN canon a ON head = a.name LEFT JOIN canon b ON tail = b.name
WHERE coalesce(a.canonical, head) <> coalesce(b.canonical, tail)""", _BEST, "canon AS (SELECT DISTINCT head AS name, 'Supplier ' || regexp_extract(head, '[0-9]+') AS canonical FROM best WHERE head LIKE 'SUPPLIER%')"))
def canon_rewrite(spark, sf_dir):
    """R6."""
    best = t.merge_best(_good(spark, sf_dir))
    canon = best.where("head like 'SUPPLIER%'").select(F.col("head").alias("name"), F.concat(F.lit("Supplier "), F.regexp_extract("head", "[0-9]+", 0)).alias("canonical")).distinct()
    return t.rewrite(best, canon).select("seq", "head", "relation", "tail")


_GROUPS = """link AS MATERIALIZED (SELECT DISTINCT lower(head) AS a, lower(tail) AS b FROM best WHERE relation = 'alternative_to'),
sym AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(name, other) AS (SELECT a, b FROM sym UNION SELECT name, b FROM reach JOIN sym ON other = a),
groups AS MATERIALIZED (SELECT name, least(name, min(other)) AS grp FROM reach GROUP BY name),
spelled AS MATERIALIZED (SELECT lower(n) AS name, arg_min(n, (pos, n)) AS shown FROM (SELECT head AS n, 2 * seq AS pos FROM best WHERE relation = 'alternative_to' UNION ALL SELECT tail, 2 * seq + 1 FROM best WHERE relation = 'alternative_to') GROUP BY lower(n))"""


@query("alt_components", _sql("SELECT name, grp, shown FROM groups JOIN spelled USING (name)", _BEST, _GROUPS, recursive=True))
def alt_components(spark, sf_dir):
    """Groups of alternatives."""
    return t.alternative_groups(materialize(t.merge_best(_good(spark, sf_dir)), "triples-best"))


_SLOTS = """slots AS MATERIALIZED (SELECT seq, relation, CASE relation WHEN 'supplies' THEN head ELSE tail END AS option, CASE relation WHEN 'supplies' THEN tail ELSE head END AS slot FROM best WHERE relation IN ('supplies', 'depends_on'))"""


@query("or_groups_component", _sql("""SELECT s.seq, s.relation || ':' || s.slot || ':' || string_agg(x.shown, '|' ORDER BY x.name) AS option_group_id, string_agg(x.shown, '|' ORDER BY x.name) FILTER (x.name <> lower(s.option)) AS alternatives
FROM slots s JOIN groups g ON g.name = lower(s.option) JOIN (SELECT groups.name, grp, shown FROM groups JOIN spelled USING (name)) o ON o.grp = g.grp
JOIN LATERAL (SELECT o.name AS name, CASE WHEN o.name = lower(s.option) THEN s.option ELSE o.shown END AS shown) x ON true GROUP BY s.seq, s.relation, s.slot, s.option""", _BEST, _GROUPS, _SLOTS, recursive=True))
def or_groups_component(spark, sf_dir):
    """R8."""
    return t.attach_component_options(materialize(t.merge_best(_good(spark, sf_dir)), "triples-best"))


@query("or_groups_slot", _sql("""SELECT seq, relation || ':' || slot AS option_group_id, coalesce((SELECT string_agg(DISTINCT o.option, '|' ORDER BY o.option) FROM slots o WHERE o.relation = s.relation AND lower(o.slot) = lower(s.slot) AND lower(o.option) <> lower(s.option)), '') AS alternatives FROM slots s""", _BEST, _SLOTS))
def or_groups_slot(spark, sf_dir):
    """R9."""
    return t.attach_slot_options(t.merge_best(_good(spark, sf_dir)))


@query("snapshot_order", _sql("SELECT head, relation, tail, row_number() OVER (PARTITION BY relation ORDER BY lower(head), lower(tail)) AS place FROM best", _BEST))
def snapshot_order(spark, sf_dir):
    """Snapshot order within a relation."""
    best = t.merge_best(_good(spark, sf_dir))
    from riskloom.functions.numbering import number_rows

    keyed = best.select("head", "relation", "tail", F.lower("head").alias("low_head"), F.lower("tail").alias("low_tail"))
    return number_rows(keyed, "relation", ["low_head", "low_tail"], "place").select("head", "relation", "tail", F.col("place").cast("bigint").alias("place"))


@query("resolvable_only", _sql("SELECT seq FROM best WHERE head IN (SELECT name FROM known) AND tail IN (SELECT name FROM known)", _BEST, "known AS (SELECT DISTINCT head AS name FROM best WHERE relation = 'depends_on')"))
def resolvable_only(spark, sf_dir):
    """R11."""
    best = t.merge_best(_good(spark, sf_dir))
    return t.resolvable(best, best.where("relation = 'depends_on'").select(F.col("head").alias("name"))).select("seq")


@query("confidence_filter", _sql("SELECT relation, count(*) AS n FROM good WHERE confidence >= 0.5 GROUP BY relation"))
def confidence_filter(spark, sf_dir):
    """X4."""
    return _good(spark, sf_dir).where("confidence >= 0.5").groupBy("relation").agg(F.count("*").alias("n"))


@query("resume_antijoin", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 5)")
def resume_antijoin(spark, sf_dir):
    """K3: what a progress log has not seen."""
    work = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    log = table(spark, sf_dir, "lineitem").where("l_linenumber >= 5").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.unprocessed(work, log, ["o_orderkey"])


@query("nodes_first_type", _sql("SELECT name, arg_min(entity_type, (pos, entity_type)) AS entity_type FROM (SELECT head AS name, head_type AS entity_type, 2 * seq AS pos FROM good UNION ALL SELECT tail, tail_type, 2 * seq + 1 FROM good) GROUP BY name"))
def nodes_first_type(spark, sf_dir):
    """G1."""
    return g.nodes_from_triples(_good(spark, sf_dir))


@query("edges_last_write", _sql("SELECT head AS src, tail AS dst, arg_max(relation, (seq, relation)) AS relation FROM good GROUP BY head, tail"))
def edges_last_write(spark, sf_dir):
    """One edge per pair, the last written."""
    rows = _good(spark, sf_dir).select(F.col("head").alias("src"), F.col("tail").alias("dst"), "relation", "seq")
    return g.collapse_pairs(rows, F.col("seq")).select("src", "dst", "relation")


@query("pair_collapse", graph_sql("SELECT src, dst, relation FROM pairs"))
def pair_collapse(spark, sf_dir):
    """G2 on the supply graph: the alphabetically last relation of a pair."""
    return g.collapse_pairs(raw_edges(spark, sf_dir), F.col("relation"))


@query("drop_self_loops", _sql("SELECT count(*) AS n FROM norm WHERE head <> tail"))
def drop_self_loops(spark, sf_dir):
    """G3."""
    rows = t.normalize(_raw(spark, sf_dir)).select(F.col("head").alias("src"), F.col("tail").alias("dst"))
    return g.drop_self_loops(rows).agg(F.count("*").alias("n"))


@query("isolated_nodes", graph_sql("SELECT name, entity_type FROM nodes WHERE name NOT IN (SELECT src FROM edges WHERE relation = 'supplies' UNION SELECT dst FROM edges WHERE relation = 'supplies')"))
def isolated_nodes(spark, sf_dir):
    """Nodes without a supply edge."""
    nodes, edges = graph(spark, sf_dir)
    return g.isolated_nodes(nodes, edges.where("relation = 'supplies'")).select("name", "entity_type")


@query("edge_weights", graph_sql("SELECT src, dst, relation, weight FROM edges"))
def edge_weights(spark, sf_dir):
    """G4."""
    return graph(spark, sf_dir)[1]


@query("graph_stats")
def graph_stats(spark, sf_dir):
    """Size, density and connectedness."""
    return g.graph_stats(*graph(spark, sf_dir))


@query("type_counts", graph_sql("SELECT entity_type, count(*) AS n FROM nodes GROUP BY entity_type"))
def type_counts(spark, sf_dir):
    """G5."""
    return graph(spark, sf_dir)[0].groupBy("entity_type").agg(F.count("*").alias("n"))


@query("relation_counts", graph_sql("SELECT relation, count(*) AS n, min(weight) AS least, max(weight) AS most FROM edges GROUP BY relation"))
def relation_counts(spark, sf_dir):
    """G5."""
    return graph(spark, sf_dir)[1].groupBy("relation").agg(F.count("*").alias("n"), F.min("weight").alias("least"), F.max("weight").alias("most"))


@query("wcc", """WITH RECURSIVE link AS MATERIALIZED (SELECT 'S:' || s_suppkey AS a, 'N:' || s_nationkey AS b FROM supplier UNION SELECT 'N:' || n_nationkey, 'R:' || n_regionkey FROM nation),
sym AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link), reach(name, other) AS (SELECT a, b FROM sym UNION SELECT name, b FROM reach JOIN sym ON other = a)
SELECT name, least(name, min(other)) AS component FROM reach GROUP BY name""")
def wcc(spark, sf_dir):
    """Weakly connected components of the place hierarchy."""
    s = table(spark, sf_dir, "supplier").selectExpr("concat('S:', s_suppkey) as src", "concat('N:', s_nationkey) as dst")
    n = table(spark, sf_dir, "nation").selectExpr("concat('N:', n_nationkey) as src", "concat('R:', n_regionkey) as dst")
    edges = s.unionByName(n)
    names = edges.select(F.col("src").alias("name")).unionByName(edges.select(F.col("dst").alias("name"))).distinct()
    return g.weak_components(names, edges)


@query("degree_centrality", graph_sql("SELECT name, count(node) AS degree, count(node)::DOUBLE / ((SELECT count(*) FROM nodes) - 1) AS centrality FROM nodes LEFT JOIN (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) ON name = node GROUP BY name"))
def degree_centrality(spark, sf_dir):
    """G6."""
    return g.degrees(*graph(spark, sf_dir))


@query("undirected", graph_sql("SELECT src, dst FROM edges UNION SELECT dst, src FROM edges"))
def undirected(spark, sf_dir):
    """G7."""
    return g.undirected(graph(spark, sf_dir)[1])


@query("patch_missing", graph_sql("SELECT src, dst, relation, weight FROM edges UNION ALL SELECT DISTINCT 'R:' || r_regionkey, 'N:' || n_nationkey, 'connects', 1.0::DOUBLE FROM region, nation WHERE n_regionkey = r_regionkey"))
def patch_missing(spark, sf_dir):
    """Add edges that are not there yet (twice, to the same effect)."""
    _, edges = graph(spark, sf_dir)
    extra = table(spark, sf_dir, "nation").selectExpr("concat('R:', n_regionkey) as src", "concat('N:', n_nationkey) as dst", "'connects' as relation", "1.0D as weight")
    return g.add_missing_edges(edges, extra.unionByName(extra))


@query("partition_staleness", graph_sql("SELECT count(*) AS overlap, (SELECT count(*) FROM nodes) AS total, NOT (count(*) >= 500 AND count(*) >= 0.2 * (SELECT count(*) FROM nodes)) AS stale FROM nodes WHERE entity_type = 'Part'"))
def partition_staleness(spark, sf_dir):
    """G9."""
    nodes, _ = graph(spark, sf_dir)
    return g.overlap_is_stale(nodes.where("entity_type = 'Part'"), nodes)
