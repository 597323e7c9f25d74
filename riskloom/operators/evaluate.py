"""Scores of extraction, retrieval and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

KEY = ["source", "head", "relation", "tail"]


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def triple_key(df: DataFrame) -> DataFrame:
    """Normalised (source, head, relation, tail) of every row, other columns kept."""
    clean = lambda c: F.btrim(F.regexp_replace(F.lower(F.trim(F.coalesce(F.col(c), F.lit("")))), r"\s+", " "), F.lit(" ,;:."))
    return df.withColumns({"source": clean("source"), "head": clean("head"), "tail": clean("tail"), "relation": F.translate(clean("relation"), "- ", "__")})


def matched(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(key columns, in_gold, in_pred) over the distinct keys of both."""
    g = triple_key(gold).select(*KEY).distinct().withColumn("in_gold", F.lit(True))
    p = triple_key(pred).select(*KEY).distinct().withColumn("in_pred", F.lit(True))
    return g.join(p, KEY, "full").na.fill(False, ["in_gold", "in_pred"])


def precision_recall(keys: DataFrame, by: list[str] | None = None) -> DataFrame:
    """gold, pred, tp, precision, recall, f1 of ``matched`` rows, per group or over all."""
    both = F.col("in_gold") & F.col("in_pred")
    agg = keys.groupBy(*(by or [])).agg(F.count_if("in_gold").alias("gold"), F.count_if("in_pred").alias("pred"), F.count_if(both).alias("tp"))
    out = agg.withColumns({"precision": safe_div(F.col("tp"), F.col("pred")), "recall": safe_div(F.col("tp"), F.col("gold"))})
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", safe_div(2 * p * r, p + r))


def direction(keys: DataFrame) -> DataFrame:
    """One row: reversed (wrong keys whose ends match a gold pair the other way), tp, accuracy."""
    pair = [F.col("source"), F.col("relation"), F.least("head", "tail").alias("a"), F.greatest("head", "tail").alias("b")]
    gold = keys.where("in_gold").select(*pair).distinct()
    wrong = keys.where("in_pred and not in_gold").select(*pair)
    reverse = wrong.join(gold, ["source", "relation", "a", "b"], "left_semi").agg(F.count("*").alias("reversed"))
    tp = keys.agg(F.count_if(F.col("in_gold") & F.col("in_pred")).alias("tp"))
    return tp.crossJoin(reverse).withColumn("accuracy", safe_div(F.col("tp"), F.col("tp") + F.col("reversed")))


def type_accuracy(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: tp, matches, accuracy of the types on the common keys; of repeated keys the last row (seq) counts."""
    last = lambda df, n: triple_key(df).groupBy(*KEY).agg(F.max(F.struct("seq", F.lower("head_type").alias("h"), F.lower("tail_type").alias("t"))).alias(n))
    both = last(gold, "g").join(last(pred, "p"), KEY)
    out = both.agg(F.count("*").alias("tp"), F.count_if((F.col("g.h") == F.col("p.h")) & (F.col("g.t") == F.col("p.t"))).alias("matches"))
    return out.withColumn("accuracy", safe_div(F.col("matches"), F.col("tp")))


def validity(pred: DataFrame) -> DataFrame:
    """One row: share of rows with evidence, and with a confidence in [0, 1]; over all rows, repeated ones too."""
    conf = F.col("confidence").try_cast("double")
    ok = F.coalesce(conf.between(0, 1), F.lit(False))
    some = F.trim(F.coalesce("evidence", F.lit(""))) != ""
    out = pred.agg(F.count("*").alias("n"), F.count_if(some).alias("with_evidence"), F.count_if(ok).alias("valid_confidence"))
    return out.withColumns({"evidence_share": safe_div(F.col("with_evidence"), F.col("n")), "confidence_share": safe_div(F.col("valid_confidence"), F.col("n"))})


def coverage(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, expected, hit, coverage): how many expected names (key, name) were found (key, name)."""
    hits = expected.join(found.select(key, "name").distinct().withColumn("_hit", F.lit(1)), [key, "name"], "left")
    out = hits.groupBy(key).agg(F.count("*").alias("expected"), F.count("_hit").alias("hit"))
    return out.withColumn("coverage", safe_div(F.col("hit"), F.col("expected")))


def grade(score: Column) -> Column:
    return F.when(score >= 0.85, "Excellent").when(score >= 0.70, "Good").when(score >= 0.50, "Fair").otherwise("Poor")
