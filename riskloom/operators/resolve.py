"""Entity resolution: keys, groups, alias maps, staged matching."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from riskloom.operators.vocabulary import LEGAL_SUFFIXES

# ---- fixed values: letters with marks and their bare forms
_MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
_BARE = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def unaccented_key(c: Column) -> Column:
    """Lower-case words without accents and punctuation."""
    out = F.regexp_replace(F.lower(F.translate(c, _MARKED, _BARE)), "[^a-z0-9_ \\t\\n]", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def entity_key(c: Column) -> Column:
    """Lower-case words without punctuation, accents kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"\s+", " "))


def company_key(c: Column) -> Column:
    """Without one trailing legal suffix, blanks collapsed, lower case."""
    bare = F.regexp_replace(F.trim(c), rf"(?i)\s+({'|'.join(LEGAL_SUFFIXES)})\.?$", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"\s+", " ")))


def group_by_key(entities: DataFrame, key: Column) -> DataFrame:
    """(entity_type, key, canonical, aliases) of entities (name, entity_type, seq): the longest name leads."""
    order = Window.partitionBy("entity_type", "key").orderBy(F.desc(F.length("name")), "seq")
    ranked = entities.withColumn("key", key).withColumn("place", F.row_number().over(order))
    rows = ranked.groupBy("entity_type", "key").agg(F.min_by("name", "place").alias("canonical"), F.sort_array(F.collect_set(F.when(F.col("place") > 1, F.col("name")))).alias("aliases"))
    return rows.select("entity_type", "key", "canonical", F.array_except("aliases", F.array("canonical")).alias("aliases"))


def alias_map(groups: DataFrame, order: Column) -> DataFrame:
    """(key, canonical): one canonical per key over all types; the greatest ``order`` wins."""
    return groups.groupBy("key").agg(F.max_by("canonical", order).alias("canonical"))


def resolve_staged(names: DataFrame, stages: list[DataFrame]) -> DataFrame:
    """(name, key, canonical, stage): the first stage (key, canonical) that knows the key; null if none does."""
    out = names
    picks = []
    for i, s in enumerate(stages):
        out = out.join(s.select("key", F.col("canonical").alias(f"_c{i}")), "key", "left")
        picks.append((F.col(f"_c{i}"), i))
    found = F.coalesce(*[c for c, _ in picks])
    stage = F.coalesce(*[F.when(c.isNotNull(), F.lit(i)) for c, i in picks])
    return out.select("name", "key", found.alias("canonical"), stage.alias("stage"))


def _ratio(a: str, b: str) -> float:
    """Indel similarity of word-sorted texts, 0 to 100; the longest common subsequence one bit a letter."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    whole = (1 << len(a)) - 1
    free = whole
    for y in b:
        used = free & places.get(y, 0)
        free = (free + used | free - used) & whole
    return 200.0 * (len(a) - free.bit_count()) / (len(a) + len(b))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Arrow-batched; candidates should be blocked before."""

    @F.pandas_udf("double")
    def ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in pairs:
            yield pd.Series([_ratio(p, q) for p, q in zip(x, y, strict=True)])

    return ratio(a, b)


def _sorted_words(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda w: w != "")), " ")


def _pairs_of_letters(c: Column) -> Column:
    n = F.length(c)
    return F.when(n > 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(c, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def fuzzy_matches(names: DataFrame, known: DataFrame, cutoff: float) -> DataFrame:
    """(name, canonical, ratio): the best known (key, canonical) at or over ``cutoff``; ties by name.

    No pair over the cutoff is missed: at most k letters of the two word-sorted keys differ then, each of which takes at most
    two letter pairs from a key, so of any 2k + 1 distinct pairs of it one is in the other key. Those of a name that
    fewest known keys have are looked up; names too short for that many meet the known keys of fitting length.
    """
    left = names.select("name", _sorted_words(F.col("key")).alias("key")).distinct()
    right = known.select("canonical", _sorted_words(F.col("key")).alias("other")).distinct()
    spare = 1 - cutoff / 100
    # the longest other key has len * (200 / cutoff - 1) letters
    most = F.floor(spare * 200 / cutoff * F.length("key") + 1e-9)
    left = left.withColumn("pairs", _pairs_of_letters(F.col("key"))).withColumn("wanted", (2 * most + 1).cast("int"))
    index = right.select("canonical", "other", F.explode(_pairs_of_letters(F.col("other"))).alias("pair"))
    often = index.groupBy("pair").agg(F.count("*").alias("n"))
    asked = left.where(F.size("pairs") >= F.col("wanted")).select("name", "key", "wanted", F.explode("pairs").alias("pair")).join(often, "pair", "left")
    asked = asked.groupBy("name", "key", "wanted").agg(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair")).alias("all"))
    asked = asked.select("name", "key", F.explode(F.transform(F.slice(F.array_sort("all"), F.lit(1), F.col("wanted")), lambda p: p["pair"])).alias("pair"))
    met = asked.join(index, "pair").select("name", "key", "canonical", "other").distinct()
    short = left.where(F.size("pairs") < F.col("wanted"))
    lengths = right.withColumn("n", F.length("other"))
    fitting = F.explode(F.sequence(F.floor(F.length("key") * cutoff / (200 - cutoff)), F.ceil(F.length("key") * (200 / cutoff - 1)))).alias("n")
    met = met.unionByName(short.select("name", "key", fitting).join(lengths, "n").select("name", "key", "canonical", "other"))
    size = 2 * F.least(F.length("key"), F.length("other")) * 100 >= cutoff * (F.length("key") + F.length("other"))
    scored = met.where(size).withColumn("ratio", token_sort_ratio(F.col("key"), F.col("other"))).where(F.col("ratio") >= cutoff)
    best = scored.groupBy("name").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "canonical")).alias("m"))
    return best.select("name", F.col("m.canonical").alias("canonical"), (-F.col("m.r")).alias("ratio"))
