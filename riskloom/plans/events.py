"""Queries on risk events, the typed graph and resolution (N*, B*, E*, X*, S6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import resolve as e
from riskloom.operators.graph import top_per_key
from riskloom.plans.base import graph, graph_sql, query
from riskloom.sources.fixtures import table
from riskloom.streaming.risk import COUNTRIES, country_expr, risk_events, root_expr

# ---- fixed values: event type -> root code -> label, and the countries users stand for
_DUCK_EVENTS = f"""ev AS MATERIALIZED (SELECT event_id, strftime(ts, '%Y%m%d') AS day, CASE event_type WHEN 'error' THEN '14' WHEN 'signup' THEN '17' WHEN 'purchase' THEN '19' WHEN 'view' THEN '04' ELSE '01' END AS root,
  {[*COUNTRIES, "XX", "YY"]}[user_id % {len(COUNTRIES) + 2} + 1] AS fips, CAST(round(value * 100) AS BIGINT) AS cents, CAST(json_extract(props, '$.k') AS INTEGER) AS articles FROM events),
risk AS MATERIALIZED (SELECT event_id, day, root, fips, cents, articles, CASE fips {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COUNTRIES.items())} END AS country,
  CASE root WHEN '14' THEN 'Protest/Strike' WHEN '17' THEN 'Sanction/Embargo' ELSE 'Armed Conflict' END AS label FROM ev WHERE fips IN ({", ".join(f"'{k}'" for k in COUNTRIES)}) AND root IN ('13', '14', '17', '18', '19', '20') AND cents > 300 AND articles >= 3)"""


def _sql(select: str) -> str:
    return f"WITH {_DUCK_EVENTS}\n{select}"


def _risk(spark, sf_dir):
    return risk_events(table(spark, sf_dir, "events"))


@query("risk_filter", _sql("SELECT event_id, root, fips, cents, articles FROM risk"))
def risk_filter(spark, sf_dir):
    """Watched country and code, severe enough, reported often enough."""
    return _risk(spark, sf_dir).select("event_id", "root", "fips", "cents", "articles")


@query("risk_labels", _sql("SELECT event_id, label || ' in ' || country || ' (' || day || ')' AS name FROM risk"))
def risk_labels(spark, sf_dir):
    """N2."""
    return _risk(spark, sf_dir).select("event_id", F.concat("label", F.lit(" in "), "country", F.lit(" ("), "day", F.lit(")")).alias("name"))


@query("risk_conf", _sql("SELECT event_id, least(0.5::DOUBLE + articles * 0.02::DOUBLE, 0.9::DOUBLE) AS confidence FROM risk"))
def risk_conf(spark, sf_dir):
    """N3."""
    return _risk(spark, sf_dir).select("event_id", F.least(F.lit(0.5) + F.col("articles") * 0.02, F.lit(0.9)).alias("confidence"))


@query("risk_countries", _sql("SELECT country, min(event_id) AS first_seen, count(*) AS kept, (SELECT count(*) FROM ev) AS scanned FROM risk GROUP BY country"))
def risk_countries(spark, sf_dir):
    """Countries as first seen, with scanned and kept counts."""
    total = table(spark, sf_dir, "events").agg(F.count("*").alias("scanned"))
    return _risk(spark, sf_dir).groupBy("country").agg(F.min("event_id").alias("first_seen"), F.count("*").alias("kept")).crossJoin(total)


@query("risk_top10_per_key", _sql("SELECT country, event_id, cents FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY cents DESC, event_id) AS rn FROM risk) WHERE rn <= 10"))
def risk_top10_per_key(spark, sf_dir):
    """The ten worst events per country."""
    return top_per_key(_risk(spark, sf_dir), ["country"], [F.desc("cents"), "event_id"], 10).select("country", "event_id", "cents")


@query("risk_by_day", _sql("SELECT day, country, count(*) AS n, max(cents) AS worst FROM risk GROUP BY day, country"))
def risk_by_day(spark, sf_dir):
    """Daily counts, the batch twin of the streaming aggregate."""
    return _risk(spark, sf_dir).groupBy("day", "country").agg(F.count("*").alias("n"), F.max("cents").alias("worst"))


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, sf_dir):
    """Fields of JSON texts by a stated schema; broken ones give null."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("event_scan", _sql("SELECT fips, root, count(*) AS n FROM ev WHERE fips IN ('TW', 'US') OR root IN ('14') GROUP BY fips, root"))
def event_scan(spark, sf_dir):
    """Rows of which any of several fields is watched."""
    ev = table(spark, sf_dir, "events").select(country_expr().alias("fips"), root_expr().alias("root"))
    return ev.where(F.col("fips").isin("TW", "US") | F.col("root").isin("14")).groupBy("fips", "root").agg(F.count("*").alias("n"))


# ---- the typed graph
def _company(edges, name: str):
    """Supply edges of a company in both directions."""
    out = edges.where(F.col("src") == name).select(F.lit("out").alias("way"), F.col("dst").alias("other"), "relation", "weight")
    into = edges.where(F.col("dst") == name).select(F.lit("in").alias("way"), F.col("src").alias("other"), "relation", "weight")
    return out.unionByName(into)


@query("company_impact", graph_sql("SELECT 'out' AS way, dst AS other, relation, weight FROM edges WHERE src = 'S:7' UNION ALL SELECT 'in', src, relation, weight FROM edges WHERE dst = 'S:7'"))
def company_impact(spark, sf_dir):
    """Everything one hop from a company, by direction and relation."""
    return _company(graph(spark, sf_dir)[1], "S:7")


@query("impact_places", graph_sql("SELECT DISTINCT e2.src AS company, e2.dst AS place FROM edges e1 JOIN edges e2 ON e1.dst = e2.src WHERE e1.src LIKE 'P:1%' AND e2.relation IN ('located_in', 'ships_through')"))
def impact_places(spark, sf_dir):
    """Places of the companies a part goes to."""
    edges = graph(spark, sf_dir)[1]
    first = edges.where("src like 'P:1%'").select(F.col("dst").alias("company"))
    second = edges.where("relation in ('located_in', 'ships_through')").select(F.col("src").alias("company"), F.col("dst").alias("place"))
    return first.join(second, "company").distinct()


_PROD = "prod AS MATERIALIZED (SELECT c_nationkey AS nation, p_brand AS mineral, count(*) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def _production(spark, sf_dir):
    read = lambda n: table(spark, sf_dir, n)
    j = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("c_nationkey").alias("nation"), F.col("p_brand").alias("mineral")).agg(F.count("*").alias("amount"))


@query("country_impact", f"WITH {_PROD} SELECT mineral, nation, amount FROM (SELECT *, row_number() OVER (PARTITION BY mineral ORDER BY CAST(amount AS VARCHAR) DESC, nation) AS rn FROM prod WHERE nation <> 3 AND mineral IN (SELECT mineral FROM prod WHERE nation = 3)) WHERE rn <= 5")
def country_impact(spark, sf_dir):
    """Five other producers of what a nation makes; amounts are ordered as the strings they are stored as."""
    p = _production(spark, sf_dir)
    others = p.where("nation <> 3").join(p.where("nation = 3").select("mineral"), "mineral", "left_semi")
    return top_per_key(others, ["mineral"], [F.desc(F.col("amount").cast("string")), "nation"], 5).select("mineral", "nation", "amount")


@query("country_impact_numeric", f"WITH {_PROD} SELECT mineral, nation, amount FROM (SELECT *, row_number() OVER (PARTITION BY mineral ORDER BY amount DESC, nation) AS rn FROM prod WHERE nation <> 3 AND mineral IN (SELECT mineral FROM prod WHERE nation = 3)) WHERE rn <= 5")
def country_impact_numeric(spark, sf_dir):
    """B3 with amounts ordered as numbers."""
    p = _production(spark, sf_dir)
    others = p.where("nation <> 3").join(p.where("nation = 3").select("mineral"), "mineral", "left_semi")
    return top_per_key(others, ["mineral"], [F.desc("amount"), "nation"], 5).select("mineral", "nation", "amount")


@query("mineral_impact", f"WITH {_PROD} SELECT nation, amount FROM prod WHERE mineral = (SELECT min(mineral) FROM prod)")
def mineral_impact(spark, sf_dir):
    """Producers of one mineral."""
    p = _production(spark, sf_dir)
    first = p.agg(F.min("mineral").alias("mineral"))
    return p.join(F.broadcast(first), "mineral").select("nation", "amount")  # one row


@query("product_supply", graph_sql("SELECT DISTINCT n.name AS part, e.src AS company, l.dst AS place FROM nodes n JOIN edges e ON e.dst = n.name AND e.relation = 'supplies' JOIN edges l ON l.src = e.src AND l.relation IN ('located_in', 'ships_through') WHERE n.entity_type = 'Part' AND contains(lower(n.label), lower('Bolt'))"))
def product_supply(spark, sf_dir):
    """Suppliers and places of parts whose name contains a keyword."""
    nodes, edges = graph(spark, sf_dir)
    parts = nodes.where("entity_type = 'Part'").where(F.contains(F.lower("label"), F.lit("bolt"))).select(F.col("name").alias("part"))
    supply = edges.where("relation = 'supplies'").select(F.col("dst").alias("part"), F.col("src").alias("company"))
    place = edges.where("relation in ('located_in', 'ships_through')").select(F.col("src").alias("company"), F.col("dst").alias("place"))
    return parts.join(supply, "part").join(place, "company").select("part", "company", "place").distinct()


@query("neighbors10", graph_sql("SELECT way, relation, other FROM (SELECT *, row_number() OVER (PARTITION BY way, relation ORDER BY other) AS rn FROM (SELECT 'out' AS way, relation, dst AS other FROM edges WHERE src = 'S:3' UNION ALL SELECT 'in', relation, src FROM edges WHERE dst = 'S:3')) WHERE rn <= 10"))
def neighbors10(spark, sf_dir):
    """Up to ten neighbours per relation and direction (a report)."""
    return top_per_key(_company(graph(spark, sf_dir)[1], "S:3"), ["way", "relation"], ["other"], 10).select("way", "relation", "other")


@query("resolve_name", "SELECT q, coalesce((SELECT min(c_name) FROM customer WHERE c_name = q), (SELECT min(c_name) FROM customer WHERE contains(lower(c_name), lower(q))), q) AS name FROM (SELECT CASE n_nationkey % 3 WHEN 0 THEN n_name ELSE CASE n_nationkey % 3 WHEN 1 THEN (SELECT c_name FROM customer WHERE c_custkey = n_nationkey) ELSE '00' || n_nationkey END END AS q FROM nation)")
def resolve_name(spark, sf_dir):
    """B1: exact name, else one that contains it, else the text itself."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    n = table(spark, sf_dir, "nation").join(c, F.col("n_nationkey") == F.col("c_custkey"), "left")
    q = n.select(F.when(F.col("n_nationkey") % 3 == 0, F.col("n_name")).when(F.col("n_nationkey") % 3 == 1, F.col("c_name")).otherwise(F.concat(F.lit("00"), F.col("n_nationkey").cast("string"))).alias("q"))
    exact = q.join(c.select(F.col("c_name").alias("q")).distinct().withColumn("exact", F.col("q")), "q", "left")
    near = q.join(c, F.contains(F.lower("c_name"), F.lower("q"))).groupBy("q").agg(F.min("c_name").alias("near"))
    return exact.join(near, "q", "left").select("q", F.coalesce("exact", "near", "q").alias("name"))


@query("coverage_checks", graph_sql("SELECT * FROM (VALUES ('suppliers', (SELECT count(*) FROM nodes WHERE entity_type = 'Supplier'), 50), ('supplies', (SELECT count(*) FROM edges WHERE relation = 'supplies'), 1000), ('alternatives', (SELECT count(*) FROM edges WHERE relation = 'alternative_to'), 1000), ('nations with suppliers', (SELECT count(DISTINCT dst) FROM edges WHERE relation = 'located_in' AND src LIKE 'S:%'), 5)) t(what, n, least)").replace("SELECT * FROM (VALUES", "SELECT what, n, n >= least AS passed FROM (VALUES"))
def coverage_checks(spark, sf_dir):
    """Counts against their least values."""
    nodes, edges = graph(spark, sf_dir)
    one = lambda what, df, n, least: df.agg(n.alias("n")).select(F.lit(what).alias("what"), "n", (F.col("n") >= least).alias("passed"))
    out = one("suppliers", nodes.where("entity_type = 'Supplier'"), F.count("*"), 50)
    out = out.unionByName(one("supplies", edges.where("relation = 'supplies'"), F.count("*"), 1000))
    out = out.unionByName(one("alternatives", edges.where("relation = 'alternative_to'"), F.count("*"), 1000))
    return out.unionByName(one("nations with suppliers", edges.where("relation = 'located_in' and src like 'S:%'"), F.count_distinct("dst"), 5))


@query("confidence_band", graph_sql("SELECT src AS company, CASE WHEN count(*) >= 10 THEN 'High' WHEN count(*) >= 4 THEN 'Medium' ELSE 'Low' END AS band FROM edges GROUP BY src"))
def confidence_band(spark, sf_dir):
    """Confidence by number of edges."""
    n = F.count("*")
    return graph(spark, sf_dir)[1].groupBy(F.col("src").alias("company")).agg(F.when(n >= 10, "High").when(n >= 4, "Medium").otherwise("Low").alias("band"))


@query("verify_counts", graph_sql("SELECT 'node ' || entity_type AS what, count(*) AS n FROM nodes GROUP BY entity_type UNION ALL SELECT 'edge ' || relation, count(*) FROM edges GROUP BY relation"))
def verify_counts(spark, sf_dir):
    """Health counts per label and relation."""
    nodes, edges = graph(spark, sf_dir)
    a = nodes.groupBy(F.concat(F.lit("node "), "entity_type").alias("what")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.concat(F.lit("edge "), "relation").alias("what")).agg(F.count("*").alias("n")))


@query("typed_load", graph_sql("SELECT e.src, e.dst, substr(repeat(e.relation || ' evidence of ' || e.src || ' and ' || e.dst || '. ', 20), 1, 500) AS evidence FROM edges e JOIN nodes a ON e.src = a.name JOIN nodes b ON e.dst = b.name JOIN (VALUES ('Supplier', 'Part', 'supplies'), ('Part', 'Customer', 'supplies'), ('Supplier', 'Region', 'located_in')) c(s, d, r) ON a.entity_type = s AND b.entity_type = d AND e.relation = r"))
def typed_load(spark, sf_dir):
    """K7: only declared (type, type, relation) combinations are loaded, evidence cut to its column's size."""
    nodes, edges = graph(spark, sf_dir)
    combos = spark.createDataFrame([("Supplier", "Part", "supplies"), ("Part", "Customer", "supplies"), ("Supplier", "Region", "located_in")], "s string, d string, relation string")
    a = nodes.select(F.col("name").alias("src"), F.col("entity_type").alias("s"))
    b = nodes.select(F.col("name").alias("dst"), F.col("entity_type").alias("d"))
    kept = edges.join(a, "src").join(b, "dst").join(F.broadcast(combos), ["s", "d", "relation"])  # three rows
    return kept.select("src", "dst", F.substr(F.repeat(F.concat("relation", F.lit(" evidence of "), "src", F.lit(" and "), "dst", F.lit(". ")), 20), F.lit(1), F.lit(500)).alias("evidence"))


@query("intent_parse", """WITH q AS (SELECT item_id, text || CASE item_id % 3 WHEN 0 THEN ' disruption in Russia' WHEN 1 THEN ' United States of supply' ELSE ' saudi arabia' END AS t FROM benchmark),
m AS (SELECT item_id, n_name, row_number() OVER (PARTITION BY item_id ORDER BY length(n_name) DESC, n_name) AS rn FROM q JOIN nation ON contains(lower(t), lower(n_name)))
SELECT q.item_id, coalesce(n_name, '') AS entity, regexp_matches(lower(t), 'disrupt|shortage|strike') AS disruption FROM q LEFT JOIN m ON q.item_id = m.item_id AND rn = 1""")
def intent_parse(spark, sf_dir):
    """The longest dictionary name inside the question, and whether it asks about a disruption."""
    tail = F.when(F.col("item_id") % 3 == 0, " disruption in Russia").when(F.col("item_id") % 3 == 1, " United States of supply").otherwise(" saudi arabia")
    q = table(spark, sf_dir, "benchmark").select("item_id", F.concat("text", tail).alias("t"))
    names = table(spark, sf_dir, "nation").select("n_name")
    hit = q.join(F.broadcast(names), F.contains(F.lower("t"), F.lower("n_name")))  # a fixed dictionary
    best = hit.groupBy("item_id").agg(F.min(F.struct((-F.length("n_name")).alias("l"), "n_name")).alias("m"))
    return q.join(best, "item_id", "left").select("item_id", F.coalesce("m.n_name", F.lit("")).alias("entity"), F.lower("t").rlike("disrupt|shortage|strike").alias("disruption"))


# ---- resolution
_ENT = "ents AS MATERIALIZED (SELECT c_custkey AS seq, CASE WHEN c_mktsegment < 'F' THEN 'Customer' ELSE 'Supplier' END AS entity_type, CASE c_custkey % 3 WHEN 0 THEN 'Firm ' || c_custkey % 90 || ', Inc' WHEN 1 THEN 'FIRM  ' || c_custkey % 90 ELSE 'firm ' || c_custkey % 90 || '!' END AS name FROM customer)"
_KEY = r"trim(regexp_replace(regexp_replace(lower(name), '[^a-z0-9_ ]', ' ', 'g'), '\s+', ' ', 'g'))"


def _entities(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    n = (F.col("c_custkey") % 90).cast("string")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Firm "), n, F.lit(", Inc"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("FIRM  "), n)).otherwise(F.concat(F.lit("firm "), n, F.lit("!")))
    return c.select(F.col("c_custkey").alias("seq"), F.when(F.col("c_mktsegment") < "F", "Customer").otherwise("Supplier").alias("entity_type"), name.alias("name"))


@query("norm_groups", f"WITH {_ENT}, r AS (SELECT *, {_KEY} AS key, row_number() OVER (PARTITION BY entity_type, {_KEY} ORDER BY length(name) DESC, seq) AS place FROM ents) SELECT entity_type, key, min(name) FILTER (place = 1) AS canonical, coalesce(string_agg(DISTINCT name, '|' ORDER BY name) FILTER (name <> c), '') AS aliases FROM (SELECT *, first_value(name) OVER (PARTITION BY entity_type, key ORDER BY place) AS c FROM r) GROUP BY entity_type, key")
def norm_groups(spark, sf_dir):
    """One canonical name per type and normalised key."""
    g = e.group_by_key(_entities(spark, sf_dir), e.unaccented_key(F.col("name")))
    return g.select("entity_type", "key", "canonical", F.array_join("aliases", "|").alias("aliases"))


@query("alias_map", f"WITH {_ENT}, r AS (SELECT *, {_KEY} AS key, row_number() OVER (PARTITION BY entity_type, {_KEY} ORDER BY length(name) DESC, seq) AS place FROM ents) SELECT key, arg_max(name, entity_type) AS canonical FROM r WHERE place = 1 GROUP BY key")
def alias_map(spark, sf_dir):
    """Keys to canonical names; the later type wins."""
    g = e.group_by_key(_entities(spark, sf_dir), e.unaccented_key(F.col("name")))
    return e.alias_map(g, F.col("entity_type"))


@query("staged_resolution", f"WITH {_ENT}, q AS (SELECT DISTINCT name, {_KEY} AS key FROM ents), s0 AS (SELECT 'firm ' || n_nationkey AS key, 'Dictionary ' || n_name AS canonical FROM nation), s1 AS (SELECT DISTINCT {_KEY} AS key, 'Known ' || {_KEY} AS canonical FROM ents WHERE seq < 60) SELECT name, q.key, coalesce(s0.canonical, s1.canonical) AS canonical, CASE WHEN s0.canonical IS NOT NULL THEN 0 WHEN s1.canonical IS NOT NULL THEN 1 END AS stage FROM q LEFT JOIN s0 USING (key) LEFT JOIN s1 USING (key)")
def staged_resolution(spark, sf_dir):
    """Dictionary, then known keys, else unresolved."""
    ents = _entities(spark, sf_dir)
    key = e.unaccented_key(F.col("name"))
    q = ents.select("name", key.alias("key")).distinct()
    s0 = table(spark, sf_dir, "nation").select(F.concat(F.lit("firm "), F.col("n_nationkey").cast("string")).alias("key"), F.concat(F.lit("Dictionary "), "n_name").alias("canonical"))
    s1 = ents.where("seq < 60").select(key.alias("key")).distinct().withColumn("canonical", F.concat(F.lit("Known "), "key"))
    return e.resolve_staged(q, [s0, s1])


@query("fuzzy_matches")
def fuzzy_matches(spark, sf_dir):
    """Word-sorted indel similarity; checked in tests."""
    q = _entities(spark, sf_dir).select("name", e.unaccented_key(F.col("name")).alias("key")).distinct()
    known = table(spark, sf_dir, "nation").select(F.concat(F.lit("firm "), F.col("n_nationkey").cast("string"), F.lit(" inc")).alias("key"), F.col("n_name").alias("canonical"))
    return e.fuzzy_matches(q, known, 88.0)


@query("resolution_stats", f"WITH {_ENT} SELECT entity_type, count(*) AS n, count(DISTINCT {_KEY}) AS keys FROM ents GROUP BY entity_type")
def resolution_stats(spark, sf_dir):
    """E9."""
    return _entities(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("n"), F.count_distinct(e.unaccented_key(F.col("name"))).alias("keys"))


@query("entity_kind", "SELECT p_partkey, CASE WHEN regexp_matches(lower(p_name), 'port|harbour') THEN 'Port' WHEN regexp_matches(lower(p_name), 'route|lane') THEN 'LogisticsRoute' WHEN regexp_matches(lower(p_type), 'steel|tin') THEN 'Part' ELSE 'Supplier' END AS kind FROM part")
def entity_kind(spark, sf_dir):
    """Type of an entity by keywords of its name and context."""
    kind = F.when(F.lower("p_name").rlike("port|harbour"), "Port").when(F.lower("p_name").rlike("route|lane"), "LogisticsRoute").when(F.lower("p_type").rlike("steel|tin"), "Part").otherwise("Supplier")
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


_PATTERNS = ((0, "supplies", " the "), (1, "depends_on", " and "), (2, "located_in", " in "))


@query("pair_relations", """WITH s AS (SELECT item_id, ' ' || lower(text) || ' ' AS t FROM benchmark), w AS (SELECT item_id, t, word, instr(t, word) AS pos FROM s, (VALUES ('that'), ('erst'), ('thor'), ('inan'), ('ere')) v(word) WHERE contains(t, word)),
p AS (SELECT a.item_id, a.t, a.word AS head, b.word AS tail, a.pos AS hp, b.pos AS tp FROM w a JOIN w b ON a.item_id = b.item_id AND (a.pos, a.word) < (b.pos, b.word)),
m AS (SELECT item_id, head, tail, k, relation, CASE WHEN hp < instr(t, pat) AND instr(t, pat) < tp THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END AS confidence FROM p JOIN (VALUES (0, 'supplies', ' the '), (1, 'depends_on', ' and '), (2, 'located_in', ' in ')) r(k, relation, pat) ON contains(t, pat))
SELECT item_id, head, tail, relation, confidence FROM (SELECT *, row_number() OVER (PARTITION BY item_id, head, tail ORDER BY confidence DESC, k) AS rn FROM m) WHERE rn = 1""")
def pair_relations(spark, sf_dir):
    """The best pattern for each ordered pair of entities in a sentence."""
    s = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit(" "), F.lower("text"), F.lit(" ")).alias("t"))
    w = s.select("*", F.explode(F.array(*map(F.lit, ("that", "erst", "thor", "inan", "ere")))).alias("word")).where(F.contains("t", F.col("word"))).withColumn("pos", F.instr("t", F.col("word")))
    a, b = w.select("item_id", "t", F.col("word").alias("head"), F.col("pos").alias("hp")), w.select("item_id", F.col("word").alias("tail"), F.col("pos").alias("tp"))
    p = a.join(b, "item_id").where(F.struct("hp", "head") < F.struct("tp", "tail"))
    pats = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("relation"), F.lit(x).alias("pat")) for k, r, x in _PATTERNS]))
    m = p.select("*", pats.alias("r")).where(F.contains("t", F.col("r.pat"))).withColumn("at", F.instr("t", F.col("r.pat")))
    m = m.withColumn("confidence", F.when((F.col("hp") < F.col("at")) & (F.col("at") < F.col("tp")), 0.85).otherwise(0.65))
    best = m.groupBy("item_id", "head", "tail").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("r.k").alias("k"), F.col("r.relation").alias("relation"))).alias("m"))
    return best.select("item_id", "head", "tail", F.col("m.relation").alias("relation"), (-F.col("m.c")).alias("confidence"))
