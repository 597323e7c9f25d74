"""Queries on intents, impacts of the typed graph, relations of sentences and community texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import community as m, extract as ex, impact, vocabulary as voc
from riskloom.plans.base import graph, graph_sql, query
from riskloom.plans.evaluation import _PART, _partition
from riskloom.plans.events import _PROD, _production
from riskloom.sources.fixtures import table

_TYPED = """typed AS MATERIALIZED (SELECT dst AS src, src AS dst, 'SUPPLIES' AS relation FROM edges WHERE relation = 'depends_on' UNION ALL SELECT src, dst, 'MANUFACTURES_FOR' FROM edges WHERE relation = 'alternative_to'
  UNION ALL SELECT src, dst, 'LOCATED_IN' FROM edges WHERE relation = 'located_in' AND dst LIKE 'N:%' UNION ALL SELECT dst, src, 'DEPENDS_ON' FROM edges WHERE relation = 'supplies' AND dst LIKE 'P:%')"""
_EVENTS = """ev AS MATERIALIZED (SELECT CAST(event_id AS VARCHAR) AS event, event_type AS label, 'N:' || (user_id % 25) AS country, -CAST(round(value * 100) AS BIGINT) AS goldstein FROM events),
worst AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY goldstein, event) AS rn FROM ev) WHERE rn <= 10)"""
_MADE = _PROD + ", produces AS MATERIALIZED (SELECT 'N:' || nation AS country, mineral, CAST(amount AS VARCHAR) AS amount FROM prod)"
_FIRMS = (("q1", "S:7"), ("q2", "C:3"))


def _asked(rows) -> str:
    return "asked(query, name) AS (VALUES " + ", ".join(f"('{q}', '{n}')" for q, n in rows) + ")"


def _company(asked: str = "asked") -> str:
    both = f"(SELECT query, src, dst, relation, dst AS other FROM typed JOIN {asked} ON src = name WHERE relation IN ('SUPPLIES', 'MANUFACTURES_FOR') UNION ALL SELECT query, src, dst, relation, src FROM typed JOIN {asked} ON dst = name WHERE relation IN ('SUPPLIES', 'MANUFACTURES_FOR'))"
    home = f"(SELECT DISTINCT query, dst AS country FROM typed JOIN {asked} ON src = name WHERE relation = 'LOCATED_IN')"
    uses = f"typed JOIN {asked} ON dst = name WHERE relation = 'DEPENDS_ON'"
    return f"""SELECT query, 'supply' AS part, src AS a, dst AS b, relation AS detail FROM {both} UNION SELECT query, 'company', other, '', '' FROM {both} UNION SELECT query, 'company', name, '', '' FROM {asked}
UNION SELECT query, 'depends', src, dst, '' FROM {uses} UNION SELECT query, 'product', src, '', '' FROM {uses}
UNION SELECT query, 'country', country, '', '' FROM {home} UNION SELECT query, 'risk', event, country, label FROM {home} JOIN worst USING (country)"""


def _typed(spark, sf_dir):
    nodes, edges = graph(spark, sf_dir)
    named = lambda df, src, dst, r: df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(r).alias("relation"))
    typed = named(edges.where("relation = 'depends_on'"), "dst", "src", "SUPPLIES").unionByName(named(edges.where("relation = 'alternative_to'"), "src", "dst", "MANUFACTURES_FOR"))
    typed = typed.unionByName(named(edges.where("relation = 'located_in' and dst like 'N:%'"), "src", "dst", "LOCATED_IN"))
    return nodes, typed.unionByName(named(edges.where("relation = 'supplies' and dst like 'P:%'"), "dst", "src", "DEPENDS_ON"))


def _happened(spark, sf_dir):
    cents = -F.round(F.col("value") * 100).cast("bigint")
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("event"), F.col("event_type").alias("label"), F.concat(F.lit("N:"), (F.col("user_id") % 25).cast("string")).alias("country"), cents.alias("goldstein"))


def _produced(spark, sf_dir):
    return _production(spark, sf_dir).select(F.concat(F.lit("N:"), F.col("nation").cast("string")).alias("country"), "mineral", F.col("amount").cast("string").alias("amount"))


def _rows(spark, rows):
    return spark.createDataFrame(list(rows), "query string, name string")


@query("impact_companies", graph_sql(_company(), _TYPED, _EVENTS, _asked(_FIRMS)))
def impact_companies(spark, sf_dir):
    """Everything a disruption of two companies touches."""
    return impact.company_impact(_rows(spark, _FIRMS), _typed(spark, sf_dir)[1], _happened(spark, sf_dir))


_LANDS = (("q3", "N:3"), ("q4", "N:11"))
_COUNTRY = """SELECT query, 'produces' AS part, country AS a, mineral AS b, amount AS detail FROM produces JOIN asked ON country = name UNION SELECT query, 'mineral', mineral, '', '' FROM produces JOIN asked ON country = name
UNION SELECT query, 'produces', country, mineral, amount FROM rivals UNION SELECT query, 'country', country, '', '' FROM rivals UNION SELECT query, 'country', name, '', '' FROM asked
UNION SELECT query, 'company', src, '', '' FROM (SELECT query, src, row_number() OVER (PARTITION BY query ORDER BY src) AS rn FROM typed JOIN asked ON dst = name WHERE relation = 'LOCATED_IN') WHERE rn <= 20
UNION SELECT query, 'risk', event, country, label FROM worst JOIN asked ON country = name"""
_RIVALS = "rivals AS (SELECT * FROM (SELECT query, p.country, p.mineral, p.amount, row_number() OVER (PARTITION BY query, p.mineral ORDER BY p.amount DESC, p.country) AS rn FROM produces p JOIN (SELECT DISTINCT query, name, mineral FROM produces JOIN asked ON country = name) o ON p.mineral = o.mineral AND p.country <> o.name) WHERE rn <= 5)"


@query("impact_countries", graph_sql(_COUNTRY, _TYPED, _EVENTS, _MADE, _asked(_LANDS), _RIVALS))
def impact_countries(spark, sf_dir):
    """Minerals, rivals, companies and events of two countries."""
    return impact.country_impact(_rows(spark, _LANDS), _typed(spark, sf_dir)[1], _produced(spark, sf_dir), _happened(spark, sf_dir))


_ORES = (("q5", "Brand#11"), ("q6", "Brand#34"))
_MINERAL = """SELECT query, 'produces' AS part, country AS a, mineral AS b, amount AS detail FROM produces JOIN asked ON mineral = name UNION SELECT query, 'country', country, '', '' FROM produces JOIN asked ON mineral = name UNION SELECT query, 'mineral', name, '', '' FROM asked
UNION SELECT query, 'risk', event, country, label FROM worst JOIN (SELECT query, country FROM (SELECT query, country, row_number() OVER (PARTITION BY query ORDER BY amount DESC, country) AS rn FROM produces JOIN asked ON mineral = name) WHERE rn <= 3) USING (country)"""


@query("impact_minerals", f"WITH {_EVENTS}, {_MADE}, {_asked(_ORES)} {_MINERAL}")
def impact_minerals(spark, sf_dir):
    """Producers of two minerals and the events of the first three."""
    return impact.mineral_impact(_rows(spark, _ORES), _produced(spark, sf_dir), _happened(spark, sf_dir))


_TEXTS = (("q7", "S:1"), ("q8", "nothing of that name"))
_FOUND = "found AS MATERIALIZED (SELECT * FROM (SELECT query, n.name, kind, row_number() OVER (PARTITION BY query, kind ORDER BY n.name) AS rn FROM (SELECT name, CASE entity_type WHEN 'Part' THEN 'product' WHEN 'Region' THEN 'country' ELSE 'company' END AS kind FROM nodes) n JOIN asked a ON contains(n.name, a.name)) WHERE rn <= 10), firms(query, name) AS (SELECT query, name FROM found WHERE kind = 'company' AND rn <= 5)"


@query("impact_general", graph_sql("SELECT query, kind AS part, name AS a, '' AS b, '' AS detail FROM found UNION " + _company("firms"), _TYPED, _EVENTS, _asked(_TEXTS), _FOUND))
def impact_general(spark, sf_dir):
    """Names that contain the text, and the impact of the first five companies among them."""
    nodes, typed = _typed(spark, sf_dir)
    kind = F.when(F.col("entity_type") == "Part", "product").when(F.col("entity_type") == "Region", "country").otherwise("company")
    return impact.general_search(_rows(spark, _TEXTS), nodes.select("name", kind.alias("kind")), typed, _happened(spark, sf_dir))


@query("impact_bands", graph_sql(f"SELECT query, n AS evidence, CASE WHEN n >= 10 THEN 'High' WHEN n >= 4 THEN 'Medium' ELSE 'Low' END AS confidence FROM (SELECT query, count(*) FILTER (part IN ('supply', 'depends', 'produces', 'risk')) AS n FROM ({_company()}) GROUP BY query)", _TYPED, _EVENTS, _asked(_FIRMS)))
def impact_bands(spark, sf_dir):
    """Confidence by the evidence found."""
    return impact.evidence_band(impact.company_impact(_rows(spark, _FIRMS), _typed(spark, sf_dir)[1], _happened(spark, sf_dir)))


_QUESTION = "CASE n_nationkey % 5 WHEN 0 THEN 'What if TSMC halts in ' || n_name WHEN 1 THEN 'What if ' || n_name || ' bans gallium exports?' WHEN 2 THEN 'Which companies supply components for the Xbox in ' || n_name WHEN 3 THEN 'What if Borealis Metals is disrupted' ELSE 'Who are you' END"
_NAMES = sorted({n for names in impact.KINDS.values() for n in names}, key=lambda n: (-len(n), n))
_HIT = "CASE " + " ".join(f"WHEN contains(lower(q), '{n}') THEN '{n}'" for n in _NAMES) + " WHEN contains(q, 'Borealis') THEN 'Borealis Metals' WHEN contains(q, 'Who') THEN 'You' END"
_KIND = "CASE " + " ".join(f"WHEN lower(entity) IN ({', '.join(map(repr, names))}) THEN '{k}'" for k, names in impact.KINDS.items()) + " ELSE 'unknown' END"


@query("intents", f"SELECT q AS question, entity, entity_type, CASE WHEN entity_type IN ('company', 'country', 'mineral') AND regexp_matches(q, '(?i){voc.ASKED_DISRUPTION}') THEN entity_type || '_disruption' WHEN entity_type = 'product' THEN 'product_supply' ELSE 'general' END AS intent FROM (SELECT *, {_KIND} AS entity_type FROM (SELECT q, {_HIT} AS entity FROM (SELECT {_QUESTION} AS q FROM nation)))")
def intents(spark, sf_dir):
    """What a question asks about, and which search it leads to."""
    k, n = F.col("n_nationkey") % 5, F.col("n_name")
    q = F.when(k == 0, F.concat(F.lit("What if TSMC halts in "), n)).when(k == 1, F.concat(F.lit("What if "), n, F.lit(" bans gallium exports?")))
    q = q.when(k == 2, F.concat(F.lit("Which companies supply components for the Xbox in "), n)).when(k == 3, "What if Borealis Metals is disrupted").otherwise("Who are you")
    return impact.parse_intents(table(spark, sf_dir, "nation").select(q.alias("question")))


_INTENTS = (("a", "S:7", "company_disruption"), ("b", "N:3", "country_disruption"), ("c", "Brand#11", "mineral_disruption"))


@query("impact_dispatch", graph_sql(f"SELECT * FROM (WITH asked AS (SELECT 'a' AS query, 'S:7' AS name) {_company()}) UNION ALL SELECT * FROM (WITH asked AS (SELECT 'b' AS query, 'N:3' AS name), {_RIVALS} {_COUNTRY}) UNION ALL SELECT * FROM (WITH asked AS (SELECT 'c' AS query, 'Brand#11' AS name) {_MINERAL})", _TYPED, _EVENTS, _MADE))
def impact_dispatch(spark, sf_dir):
    """Each question to the search of its intent."""
    nodes, typed = _typed(spark, sf_dir)
    asked = spark.createDataFrame(list(_INTENTS), "query string, entity string, intent string")
    return impact.impact_of(asked, nodes.select("name", F.lit("product").alias("kind")), typed, _produced(spark, sf_dir), _happened(spark, sf_dir))


_SAYS = tuple(p for p in ("supplies", "depends on", "ships through", "based in", "affected by", "sells to", "and"))
_MENTION = "'Supplier ' || s_suppkey || ' ' || " + f"{list(_SAYS)}[s_suppkey % {len(_SAYS)} + 1]" + " || ' Nation ' || s_nationkey || CASE s_suppkey % 3 WHEN 0 THEN ' requires Port X' ELSE ' near Port X' END"
_MATCHED = ", ".join(f"({k}, '{r}', '{p}')" for k, (p, r) in enumerate(voc.RELATION_PHRASES))


@query("sentence_relations", f"""WITH s AS (SELECT s_suppkey AS sentence_id, {_MENTION} AS t, ['Supplier ' || s_suppkey, 'Nation ' || s_nationkey, 'Port X'] AS names FROM supplier),
n AS (SELECT sentence_id, t, unnest(range(3)) AS i, unnest(names) AS name FROM s), p AS (SELECT a.sentence_id, a.t, a.name AS head, b.name AS tail, instr(lower(a.t), lower(a.name)) AS hp, instr(lower(a.t), lower(b.name)) AS tp FROM n a JOIN n b ON a.sentence_id = b.sentence_id AND a.i < b.i),
h AS (SELECT sentence_id, head, tail, k, relation, CASE WHEN hp < at_ AND at_ < tp THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END AS confidence FROM (SELECT p.*, k, relation, instr(t, regexp_extract(t, '(?i)' || phrase)) AS at_ FROM p JOIN (VALUES {_MATCHED}) v(k, relation, phrase) ON regexp_matches(t, '(?i)' || phrase)))
SELECT sentence_id, head, tail, relation, confidence FROM (SELECT *, row_number() OVER (PARTITION BY sentence_id, head, tail ORDER BY confidence DESC, k) AS rn FROM h) WHERE rn = 1""")
def sentence_relations(spark, sf_dir):
    """The relation between the names of a sentence."""
    s = table(spark, sf_dir, "supplier")
    head, place = F.concat(F.lit("Supplier "), F.col("s_suppkey").cast("string")), F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"))
    verb = F.element_at(F.array(*map(F.lit, _SAYS)), (F.col("s_suppkey") % len(_SAYS) + 1).cast("int"))
    text = F.concat(F.concat_ws(" ", head, verb, place), F.when(F.col("s_suppkey") % 3 == 0, " requires Port X").otherwise(" near Port X"))
    return ex.sentence_relations(s.select(F.col("s_suppkey").alias("sentence_id"), text.alias("sentence"), F.array(head, place, F.lit("Port X")).alias("names")))


@query("component_makers", f"SELECT p_partkey AS guide_id, CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE p_name END AS product, maker, 'DEPENDS_ON' AS relation, 0.6::DOUBLE AS confidence FROM part, (SELECT unnest({list(voc.MANUFACTURERS)}) AS maker) WHERE contains(lower(p_type || ' chip by ' || {list(voc.MANUFACTURERS)}[p_partkey % 13 + 1] || ' and bosch'), lower(maker))")
def component_makers(spark, sf_dir):
    """Manufacturers named in teardowns."""
    maker = F.element_at(F.array(*map(F.lit, voc.MANUFACTURERS)), (F.col("p_partkey") % 13 + 1).cast("int"))
    subject = F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.col("p_name"))
    return ex.component_makers(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("guide_id"), subject.alias("subject"), F.col("p_brand").alias("category"), F.lit("t").alias("title"), F.concat("p_type", F.lit(" chip by "), maker, F.lit(" and bosch")).alias("text")))


@query("filing_relations", """WITH s AS (SELECT 'Filer ' || n_regionkey AS filer, n_nationkey AS place, CASE n_nationkey % 2 WHEN 0 THEN 'foundry' ELSE 'rely on' END AS keyword, repeat('near ' || n_name || ' ', 40) AS evidence, 'Works of ' || n_name AS org, n_name AS gpe FROM nation)
SELECT filer, org AS src, filer AS dst, CASE keyword WHEN 'foundry' THEN 'MANUFACTURES_FOR' ELSE 'SUPPLIES' END AS relation, 0.7::DOUBLE AS confidence, substr(evidence, 1, 300) AS evidence FROM s
UNION ALL SELECT filer, org, gpe, 'LOCATED_IN', 0.5::DOUBLE, substr(evidence, 1, 300) FROM s WHERE length(gpe) >= 4""")
def filing_relations(spark, sf_dir):
    """Organisations and places near a keyword of a filing."""
    n = table(spark, sf_dir, "nation")
    one = lambda c, k: F.struct(c.alias("name"), F.lit(k).alias("kind"))
    names = F.array(one(F.concat(F.lit("Works of "), "n_name"), "ORG"), one(F.col("n_name"), "GPE"))
    rows = n.select(F.concat(F.lit("Filer "), F.col("n_regionkey").cast("string")).alias("filer"), F.col("n_nationkey").alias("place"), F.when(F.col("n_nationkey") % 2 == 0, "foundry").otherwise("rely on").alias("keyword"), F.repeat(F.concat(F.lit("near "), "n_name", F.lit(" ")), 40).alias("evidence"), names.alias("names"))
    return ex.filing_relations(rows)


@query("community_texts", graph_sql("""SELECT c.community, 'Supply chain community: ' || dominant_type || ' cluster with ' || size || ' entities. Entities: ' || names || '.' || coalesce(' Relationships: ' || lines, '') AS text
FROM (SELECT community, sum(n)::BIGINT AS size, arg_min(entity_type, (-n, entity_type)) AS dominant_type FROM (SELECT community, entity_type, count(*) AS n FROM part_ JOIN nodes USING (name) GROUP BY ALL) GROUP BY community) c
JOIN (SELECT community, string_agg(name || ' (' || entity_type || ')', ', ' ORDER BY name) AS names FROM (SELECT community, name, entity_type, row_number() OVER (PARTITION BY community ORDER BY name) AS rn FROM part_ JOIN nodes USING (name)) WHERE rn <= 15 GROUP BY community) USING (community)
LEFT JOIN (SELECT community, string_agg(src || ' ' || relation || ' ' || dst || '.', ' ' ORDER BY src, dst) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY src, dst) AS rn FROM inner_) WHERE rn <= 20 GROUP BY community) USING (community) WHERE size >= 2""",
    _PART, "inner_ AS MATERIALIZED (SELECT e.*, a.community FROM edges e JOIN part_ a ON e.src = a.name JOIN part_ b ON e.dst = b.name WHERE a.community = b.community)"))
def community_texts(spark, sf_dir):
    """M4: what a summariser reads of each community."""
    nodes, edges = graph(spark, sf_dir)
    part = _partition(edges)
    return m.community_texts(m.describe(part, nodes, edges), part, nodes, edges)
