"""Validating, normalising, turning and merging relationship triples.

Triples are (seq, head, head_type, relation, tail, tail_type, confidence, ...); ``seq`` is the
order in which they were read; rows of one ``seq`` are ordered by their other columns, as they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from riskloom import schema
from riskloom.operators.components import connected_components

# ---- fixed values: words for entity types
TYPE_WORDS = {
    "supplier": "Supplier", "manufacturer": "Manufacturer", "part": "Part", "port": "Port", "customer": "Customer",
    "city": "Region", "country": "Region", "province": "Region", "state": "Region", "location": "Region", "place": "Region", "gpe": "Region", "region": "Region",
    "route": "LogisticsRoute", "shippinglane": "LogisticsRoute", "shippingroute": "LogisticsRoute", "searoute": "LogisticsRoute", "waterway": "LogisticsRoute",
    "strait": "LogisticsRoute", "canal": "LogisticsRoute", "corridor": "LogisticsRoute", "logisticsroute": "LogisticsRoute",
    "event": "DisruptionEvent", "incident": "DisruptionEvent", "conflict": "DisruptionEvent", "war": "DisruptionEvent", "sanction": "DisruptionEvent",
    "blockade": "DisruptionEvent", "disruptionevent": "DisruptionEvent",
}
EDGE_MARKS = " ,;:."


def clean_name(c: Column) -> Column:
    """Collapse white space and strip blanks and marks at both ends."""
    return F.btrim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\r\f\x0b]+", " "), F.lit(EDGE_MARKS))


def clean_relation(c: Column) -> Column:
    return F.translate(F.lower(clean_name(c)), "- ", "__")


def clean_type(c: Column) -> Column:
    """The vocabulary's type for a word or a synonym; other words stay."""
    table = F.create_map(*[F.lit(x) for pair in TYPE_WORDS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.replace(F.lower(clean_name(c)), F.lit(" "), F.lit(""))), clean_name(c))


def clean_confidence(c: Column) -> Column:
    """A number clamped to [0, 1]; 0.7 where there is none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.try_cast("double"), F.lit(0.7))))


def normalize(triples: DataFrame) -> DataFrame:
    return triples.withColumns({
        "head": clean_name(F.col("head")), "tail": clean_name(F.col("tail")), "relation": clean_relation(F.col("relation")),
        "head_type": clean_type(F.col("head_type")), "tail_type": clean_type(F.col("tail_type")), "confidence": clean_confidence(F.col("confidence")),
    })


def valid(triples: DataFrame) -> DataFrame:
    """Named, different ends; relation and types of the vocabulary."""
    named = (F.col("head") != "") & (F.col("tail") != "") & (F.lower("head") != F.lower("tail"))
    known = F.col("relation").isin(*schema.RELATIONS) & F.col("head_type").isin(*schema.ENTITY_TYPES) & F.col("tail_type").isin(*schema.ENTITY_TYPES)
    return triples.where(named & known)


def _first(triples: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key; an aggregate that is combined before the shuffle."""
    names = triples.columns
    row = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)], *[F.col(c) for c in names])
    best = triples.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min(row).alias("_row"))
    return best.select(*[F.col("_row")[c].alias(c) for c in names])


def _key() -> list[Column]:
    return [F.lower("head"), F.col("relation"), F.lower("tail")]


def dedupe_first(triples: DataFrame, within: list[str]) -> DataFrame:
    """The first of equal (lower-cased) triples inside each chunk."""
    return _first(triples, [*map(F.col, within), *_key()], [F.col("seq")])


def merge_best(triples: DataFrame) -> DataFrame:
    """Of equal triples the one of greatest confidence, the earliest among equals."""
    return _first(triples, _key(), [-F.col("confidence"), F.col("seq")])


def _turned(t: Column, names: list[str]) -> Column:
    swap = {"head": "tail", "tail": "head", "head_type": "tail_type", "tail_type": "head_type"}
    return F.struct(*[t[swap.get(c, c)].alias(c) for c in names])


def _rows(triples: DataFrame, pick: Column) -> DataFrame:
    return triples.select(F.explode(pick).alias("t")).select("t.*")


def direct_located_in(triples: DataFrame) -> DataFrame:
    """located_in runs from a region to what lies in it, events point at regions, region pairs run both ways."""
    names = triples.columns
    same = F.struct(*[F.col(c) for c in names])
    turned = _turned(same, names)
    head_region, tail_region = F.col("head_type") == "Region", F.col("tail_type") == "Region"
    head_event, tail_event = F.col("head_type") == "DisruptionEvent", F.col("tail_type") == "DisruptionEvent"
    pick = (
        F.when(F.col("relation") != "located_in", F.array(same)).when(head_event & tail_region, F.array(same)).when(tail_event & head_region, F.array(turned))
        .when(head_region & tail_region, F.array(same, turned)).when(tail_region, F.array(turned)).otherwise(F.array(same))
    )
    return _rows(triples, pick)


def direct_affected_by(triples: DataFrame) -> DataFrame:
    """affected_by runs from the event to what it strikes."""
    names = triples.columns
    same = F.struct(*[F.col(c) for c in names])
    turn = (F.col("relation") == "affected_by") & (F.col("tail_type") == "DisruptionEvent") & (F.col("head_type") != "DisruptionEvent")
    return _rows(triples, F.array(F.when(turn, _turned(same, names)).otherwise(same)))


def rewrite(triples: DataFrame, canon: DataFrame) -> DataFrame:
    """Replace names by their canonical ones (name, canonical); self-loops that arise go."""
    out = triples
    for end in ("head", "tail"):
        names = canon.select(F.col("name").alias(end), F.col("canonical").alias(f"_{end}"))
        out = out.join(names, end, "left").withColumn(end, F.coalesce(f"_{end}", end)).drop(f"_{end}")
    return out.where("head <> tail").select(*triples.columns)


def resolvable(triples: DataFrame, known: DataFrame) -> DataFrame:
    """Triples whose ends both resolve to a known (name)."""
    names = known.select("name").distinct()
    out = triples.join(names.withColumnRenamed("name", "head"), "head", "left_semi")
    return out.join(names.withColumnRenamed("name", "tail"), "tail", "left_semi").select(*triples.columns)


def alternative_groups(triples: DataFrame) -> DataFrame:
    """(name, grp, shown): lower-cased members of each group of alternatives and their first-seen spelling."""
    alts = triples.where("relation = 'alternative_to'").where("lower(head) <> lower(tail)").where("head <> '' and tail <> ''")
    found = connected_components(alts.select(F.lower("head").alias("a"), F.lower("tail").alias("b")))
    ends = alts.select(F.col("head").alias("n"), (2 * F.col("seq")).alias("at")).unionByName(alts.select(F.col("tail").alias("n"), (2 * F.col("seq") + 1).alias("at")))
    shown = ends.groupBy(F.lower("n").alias("node")).agg(F.min_by("n", F.struct("at", "n")).alias("shown"))
    return found.join(shown, "node").select(F.col("node").alias("name"), F.col("component").alias("grp"), "shown")


def _slot(triples: DataFrame) -> DataFrame:
    supplies = F.col("relation") == "supplies"
    eligible = triples.where(F.col("relation").isin("supplies", "depends_on"))
    return eligible.withColumn("option", F.when(supplies, F.col("head")).otherwise(F.col("tail"))).withColumn("slot", F.when(supplies, F.col("tail")).otherwise(F.col("head")))


def attach_component_options(triples: DataFrame) -> DataFrame:
    """OR-options of supply edges from the groups of alternatives: seq, option_group_id, alternatives."""
    groups = alternative_groups(triples)
    # the sorted members of a group once, and not one row for each pair of them
    members = groups.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("name", "shown"))).alias("members"))
    mine = _slot(triples).withColumn("name", F.lower("option")).join(groups.select("name", "grp"), "name").join(members, "grp")
    own = F.col("name")
    all_shown = F.transform("members", lambda m: F.when(m["name"] == own, F.col("option")).otherwise(m["shown"]))
    others = F.transform(F.filter("members", lambda m: m["name"] != own), lambda m: m["shown"])
    return mine.select(
        "seq", F.concat(F.col("relation"), F.lit(":"), F.col("slot"), F.lit(":"), F.array_join(all_shown, "|")).alias("option_group_id"),
        F.array_join(others, "|").alias("alternatives"),
    )


def attach_slot_options(triples: DataFrame) -> DataFrame:
    """OR-options of supply edges that fill the same slot: seq, option_group_id, alternatives."""
    slots = _slot(triples).withColumn("key", F.lower("slot"))
    options = slots.groupBy("relation", "key").agg(F.array_sort(F.collect_set("option")).alias("options"))
    joined = slots.join(options, ["relation", "key"])
    others = F.filter("options", lambda x: F.lower(x) != F.lower("option"))
    return joined.select("seq", F.concat_ws(":", "relation", "slot").alias("option_group_id"), F.array_join(others, "|").alias("alternatives"))


def unprocessed(work: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """Work whose key is not in the append-only progress log."""
    return work.join(log.select(*key).distinct(), key, "left_anti")
