"""Pluggable extraction: entities, triples, canonical names; offline defaults need no model."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskloom.functions.numbering import number_rows
from riskloom.operators import vocabulary as voc

Extractor = Callable[[str], list[tuple[str, str, str, float]]]

#: Default relation phrases between two capitalised names.
PHRASES = (("supplies", r"suppl(?:y|ies|ied)"), ("depends_on", r"(?:depends?|rel(?:y|ies)) on"), ("located_in", r"(?:is )?(?:located|based) in"), ("ships_through", r"ships? (?:through|via)"))
_NAME = r"([A-Z][\w&-]*(?: [A-Z][\w&-]*)*)"


def regex_extractor(text: str) -> list[tuple[str, str, str, float]]:
    """(head, relation, tail, confidence) of sentences of the form Name phrase Name."""
    found = []
    for relation, phrase in PHRASES:
        for m in re.finditer(rf"{_NAME} {phrase} {_NAME}", text or ""):
            found.append((m.group(1), relation, m.group(2).rstrip("."), 0.85))
    return found


def extract_triples(chunks: DataFrame, key: str, text: str, extractor: Extractor = regex_extractor) -> DataFrame:
    """(key, head, relation, tail, confidence, evidence) of each chunk; a failing chunk is retried by Spark's task retry."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, *t, (s or "")[:500]) for k, s in zip(b[key], b[text], strict=True) for t in extractor(s)]
            yield pd.DataFrame(rows, columns=[key, "head", "relation", "tail", "confidence", "evidence"])

    return chunks.select(key, text).mapInPandas(run, f"{key} {dict(chunks.dtypes)[key]}, head string, relation string, tail string, confidence double, evidence string")


def sentence_relations(mentions: DataFrame, key: str = "sentence_id") -> DataFrame:
    """(key, head, tail, relation, confidence) of ``mentions`` (key, sentence, names): the relation of each pair of names, in their order.

    0.85 where the first match of a phrase lies between the first places of the names, else 0.65; the first best phrase wins.
    """
    low = lambda c: F.lower(c)
    numbered = mentions.select(key, "sentence", F.posexplode("names").alias("i", "name"))
    heads = numbered.select(key, "sentence", F.col("i").alias("hi"), F.col("name").alias("head"))
    tails = numbered.select(key, F.col("i").alias("ti"), F.col("name").alias("tail"))
    pairs = heads.join(tails, key).where("hi < ti")
    pairs = pairs.withColumn("hp", F.instr(low("sentence"), low("head"))).withColumn("tp", F.instr(low("sentence"), low("tail"))).where("hp > 0 and tp > 0")
    found = F.array(*[F.struct(F.regexp_instr("sentence", F.lit(f"(?i){p}")).alias("at"), F.lit(k).alias("k"), F.lit(r).alias("r")) for k, (p, r) in enumerate(voc.RELATION_PHRASES)])
    hits = pairs.withColumn("hits", F.filter(found, lambda f: f["at"] > 0)).where(F.size("hits") > 0)
    ranked = F.transform("hits", lambda f: F.struct(F.when((F.col("hp") < f["at"]) & (f["at"] < F.col("tp")), -0.85).otherwise(-0.65).alias("c"), f["k"].alias("k"), f["r"].alias("r")))
    best = hits.withColumn("best", F.array_min(ranked))
    return best.select(key, "head", "tail", F.col("best.r").alias("relation"), (-F.col("best.c")).alias("confidence"))


def component_makers(guides: DataFrame) -> DataFrame:
    """(guide_id, product, maker, relation, confidence): the known manufacturers that a teardown's text names.

    ``guides`` has (guide_id, subject, category, title, text); the product is the first of them that is not empty.
    """
    product = F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in ("subject", "category", "title")])
    named = F.filter(F.array(*map(F.lit, voc.MANUFACTURERS)), lambda m: F.contains(F.lower("text"), F.lower(m)))
    rows = guides.where(F.trim(F.coalesce("text", F.lit(""))) != "").select("guide_id", product.alias("product"), F.explode(named).alias("maker"))
    return rows.where("product is not null").select("guide_id", "product", "maker", F.lit("DEPENDS_ON").alias("relation"), F.lit(0.6).alias("confidence"))


def filing_relations(snippets: DataFrame) -> DataFrame:
    """Relations that snippets of filings (filer, place, keyword, evidence, names) give; names are (name, kind) with kind ORG or GPE.

    An organisation relates to the filer by the snippet's keyword (0.7); a place holds every other organisation of the
    snippet (0.5). Of equal relations of a filing the first by place stays.
    """
    from riskloom.operators.text import filing_entity_ok, keyword_relation

    each = snippets.select("filer", "place", "keyword", F.substr("evidence", F.lit(1), F.lit(300)).alias("evidence"), "names", F.explode("names").alias("n"))
    good = each.where(filing_entity_ok(F.col("n.name"), F.col("filer")))
    own = good.where("n.kind = 'ORG'").select("filer", "place", F.col("n.name").alias("src"), F.col("filer").alias("dst"), keyword_relation(F.col("keyword")).alias("relation"), F.lit(0.7).alias("confidence"), "evidence")
    at = good.where("n.kind = 'GPE'").select("filer", "place", F.col("n.name").alias("dst"), "evidence", F.explode("names").alias("o"))
    located = at.where("o.kind = 'ORG' and o.name <> dst").select("filer", "place", F.col("o.name").alias("src"), "dst", F.lit("LOCATED_IN").alias("relation"), F.lit(0.5).alias("confidence"), "evidence")
    first = own.unionByName(located).groupBy("filer", "src", "dst", "relation").agg(F.min(F.struct("place", "evidence", "confidence")).alias("f"))
    return first.select("filer", "src", "dst", "relation", F.col("f.confidence").alias("confidence"), F.col("f.evidence").alias("evidence"))


def name_batches(entities: DataFrame, size: int = 200) -> DataFrame:
    """(entity_type, batch, names): sorted names in batches for a canonicaliser, numbered per type."""
    numbered = number_rows(entities.select("entity_type", "name").distinct(), "entity_type", ["name"], "place").withColumn("batch", F.floor((F.col("place") - 1) / size))
    return numbered.groupBy("entity_type", "batch").agg(F.sort_array(F.collect_list("name")).alias("names"))


def keep_turn(c: Column, strong: list[str], secondary: list[str], finance: list[str], min_words: int = 20) -> Column:
    """A strong keyword, or two secondary ones unless the text is about finance alone."""
    from riskloom.operators.text import keyword_hits, word_count

    n_strong, n_second, n_finance = (F.size(keyword_hits(c, w)) for w in (strong, secondary, finance))
    finance_only = (n_finance > 0) & (n_strong == 0) & (n_second < 2)
    return (word_count(c) >= min_words) & ((n_strong > 0) | ((n_second >= 2) & ~finance_only))


def resolve_ground_zero(names: DataFrame, nodes: DataFrame, index: DataFrame, vectors: DataFrame) -> DataFrame:
    """(name, node, exact): the node of that name, else the nearest by inner product (no threshold).

    ``index`` has (id, vector) of nodes, ``vectors`` (query, qvec) of the names.
    """
    from riskloom.operators.vectors import search

    exact = names.join(nodes.select("name").distinct().withColumn("node", F.col("name")), "name", "left")
    open_names = exact.where("node is null").select("name")
    near = search(index, vectors.join(open_names, F.col("query") == F.col("name"), "left_semi"), 1)
    out = exact.join(near.select(F.col("query").alias("name"), F.col("id").alias("nearest")), "name", "left")
    return out.select("name", F.coalesce("node", "nearest").alias("node"), F.col("node").isNotNull().alias("exact"))
