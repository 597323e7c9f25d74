"""Intent of a question, and the impact of a disruption on companies, countries and minerals of a typed graph.

The graph is ``edges`` (src, dst, relation, evidence, confidence) with the relations SUPPLIES, MANUFACTURES_FOR, LOCATED_IN
and DEPENDS_ON, ``produces`` (country, mineral, amount, reserves) and ``events`` (event, label, day, country, goldstein).
Impacts are rows (query, part, a, b, detail) for every row (query, name) of ``asked``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from riskloom.operators import vocabulary as voc
from riskloom.operators.graph import top_per_key

KINDS = {"company": voc.ASKED_COMPANIES, "country": voc.ASKED_COUNTRIES, "mineral": voc.ASKED_MINERALS, "product": voc.ASKED_PRODUCTS}


def find_entity(question: Column) -> Column:
    """The longest dictionary name in the question (ties: the first by letters), else its longest run of words that do not
    belong to questions, in title case; "" if there is none."""
    low = F.lower(question)
    known = sorted({n for names in KINDS.values() for n in names}, key=lambda n: (-len(n), n))
    hit = F.coalesce(*[F.when(F.contains(low, F.lit(n)), n) for n in known])
    clean = F.transform(F.split(low, r"\s+"), lambda w: F.regexp_replace(w, "[^a-z0-9]", ""))
    # words of questions and words that begin with no letter end a run
    marked = F.transform(clean, lambda w: F.when(w.rlike("^[a-z]") & ~w.isin(*voc.QUESTION_WORDS), F.initcap(w)).otherwise("\n"))
    runs = F.transform(F.split(F.array_join(marked, " "), "\n"), lambda r: F.trim(r))
    longest = F.aggregate(runs, F.lit(""), lambda best, r: F.when(F.length(r) > F.length(best), r).otherwise(best))
    return F.coalesce(hit, longest)


def parse_intents(questions: DataFrame, column: str = "question") -> DataFrame:
    """Add entity, entity_type and intent."""
    low = F.lower("entity")
    kind = reduce(lambda c, k: c.when(low.isin(*KINDS[k]), k), list(KINDS)[1:], F.when(low.isin(*KINDS["company"]), "company")).otherwise("unknown")
    disrupted = F.col(column).rlike("(?i)" + voc.ASKED_DISRUPTION)
    intent = F.when(disrupted & F.col("entity_type").isin("company", "country", "mineral"), F.concat("entity_type", F.lit("_disruption")))
    intent = intent.when(F.col("entity_type") == "product", "product_supply").otherwise("general")
    return questions.withColumn("entity", find_entity(F.col(column))).withColumn("entity_type", kind).withColumn("intent", intent)


def _rows(df: DataFrame, part: str, a: Column, b: Column | None = None, detail: Column | None = None) -> DataFrame:
    text = lambda c: F.lit("") if c is None else c.cast("string")
    return df.select("query", F.lit(part).alias("part"), text(a).alias("a"), text(b).alias("b"), text(detail).alias("detail"))


def country_risks(places: DataFrame, events: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` events of least score of each place (query, country)."""
    worst = top_per_key(events.join(places.select("country").distinct(), "country", "left_semi"), ["country"], ["goldstein", "event"], n)
    return _rows(places.join(worst, "country"), "risk", F.col("event"), F.col("country"), F.col("label"))


def company_impact(asked: DataFrame, edges: DataFrame, events: DataFrame) -> DataFrame:
    """Supply edges both ways, products that depend on the company, its countries and their worst events."""
    named = asked.select("query", "name").distinct()
    supply = edges.where(F.col("relation").isin("SUPPLIES", "MANUFACTURES_FOR"))
    out = supply.join(named, supply.src == named.name).select("query", "src", "dst", "relation", F.col("dst").alias("other"))
    into = supply.join(named, supply.dst == named.name).select("query", "src", "dst", "relation", F.col("src").alias("other"))
    both = out.unionByName(into)
    uses = edges.where("relation = 'DEPENDS_ON'")
    uses = uses.join(named, uses.dst == named.name).select("query", "src", "dst")
    home = edges.where("relation = 'LOCATED_IN'")
    home = home.join(named, home.src == named.name).select("query", F.col("dst").alias("country")).distinct()
    parts = [
        _rows(both, "supply", F.col("src"), F.col("dst"), F.col("relation")), _rows(both, "company", F.col("other")), _rows(named, "company", F.col("name")),
        _rows(uses, "depends", F.col("src"), F.col("dst")), _rows(uses, "product", F.col("src")), _rows(home, "country", F.col("country")),
        country_risks(home, events),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def country_impact(asked: DataFrame, edges: DataFrame, produces: DataFrame, events: DataFrame, rivals: int = 5, companies: int = 20) -> DataFrame:
    """Minerals of the country, five other producers of each (amounts order as the strings they are), up to 20 companies there, its events."""
    named = asked.select("query", F.col("name").alias("country")).distinct()
    own = produces.join(named, "country")
    others = produces.withColumnRenamed("country", "rival").join(own.select("query", "country", "mineral").distinct(), "mineral").where("rival <> country")
    others = top_per_key(others, ["query", "mineral"], [F.desc(F.col("amount").cast("string")), "rival"], rivals)
    there = edges.where("relation = 'LOCATED_IN'").select(F.col("src").alias("company"), F.col("dst").alias("country")).join(named, "country")
    there = top_per_key(there, ["query"], ["company"], companies)
    parts = [
        _rows(own, "produces", F.col("country"), F.col("mineral"), F.col("amount")), _rows(own, "mineral", F.col("mineral")),
        _rows(others, "produces", F.col("rival"), F.col("mineral"), F.col("amount")), _rows(others, "country", F.col("rival")),
        _rows(there, "company", F.col("company")), _rows(named, "country", F.col("country")), country_risks(named, events),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def mineral_impact(asked: DataFrame, produces: DataFrame, events: DataFrame, first: int = 3) -> DataFrame:
    """All producers, and the events of the first three by amount (ordered as strings)."""
    named = asked.select("query", F.col("name").alias("mineral")).distinct()
    made = produces.join(named, "mineral")
    leading = top_per_key(made, ["query"], [F.desc(F.col("amount").cast("string")), "country"], first).select("query", "country")
    parts = [
        _rows(made, "produces", F.col("country"), F.col("mineral"), F.col("amount")), _rows(made, "country", F.col("country")),
        _rows(named, "mineral", F.col("mineral")), country_risks(leading, events),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def general_search(asked: DataFrame, nodes: DataFrame, edges: DataFrame, events: DataFrame, per_kind: int = 10, companies: int = 5) -> DataFrame:
    """Up to ten names of each kind (name, kind) that contain the text, and the impact of the first five companies."""
    hits = nodes.crossJoin(F.broadcast(asked.select("query", F.col("name").alias("text")))).where(F.contains("name", F.col("text")))  # few stated questions
    hits = top_per_key(hits, ["query", "kind"], ["name"], per_kind)
    firms = top_per_key(hits.where("kind = 'company'"), ["query"], ["name"], companies).select("query", "name")
    found = hits.select("query", F.col("kind").alias("part"), F.col("name").alias("a"), F.lit("").alias("b"), F.lit("").alias("detail"))
    return found.unionByName(company_impact(firms, edges, events)).distinct()


def impact_of(intents: DataFrame, nodes: DataFrame, edges: DataFrame, produces: DataFrame, events: DataFrame) -> DataFrame:
    """Dispatch (query, entity, intent): each question to the search of its intent."""
    of = lambda i: intents.where(F.col("intent") == i).select("query", F.col("entity").alias("name"))
    parts = [
        company_impact(of("company_disruption"), edges, events), country_impact(of("country_disruption"), edges, produces, events),
        mineral_impact(of("mineral_disruption"), produces, events), general_search(of("general"), nodes, edges, events),
    ]
    return reduce(DataFrame.unionByName, parts)


def evidence_band(impact: DataFrame) -> DataFrame:
    """(query, evidence, confidence) by the number of edges and events: High from 10, Medium from 4."""
    n = F.count_if(F.col("part").isin("supply", "depends", "produces", "risk"))
    out = impact.groupBy("query").agg(n.alias("evidence"))
    return out.withColumn("confidence", F.when(F.col("evidence") >= 10, "High").when(F.col("evidence") >= 4, "Medium").otherwise("Low"))


def check_counts(checks: list[tuple[str, DataFrame, int]]) -> DataFrame:
    """(what, n, passed): the rows of each frame against its least number."""
    one = lambda what, df, least: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n", (F.col("n") >= least).alias("passed"))
    return reduce(DataFrame.unionByName, [one(*c) for c in checks])
