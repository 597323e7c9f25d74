"""Quality rules with risk-controlled thresholds, in SQL expressions only.

Each rule rejects a document whose signal exceeds a cutoff. Cutoffs come from a
fixed grid. For a stratum (``lang``) and rule, the labelled good documents are a
holdout: the exact binomial test P(Bin(n, alpha / rules) <= rejected good) must be
at most delta / (strata * rules). Cutoffs are tested from the loosest on and testing
stops at the first failure (fixed sequence), so with probability 1 - delta no
chosen cutoff rejects more than its share of good documents, and all rules
together at most ``alpha`` per stratum. Among certified cutoffs the one with the
most bad minus PRICE times good rejections is taken (ties: the loosest); none if
that gains nothing. Labels choose cutoffs only; they are no signal.

Defined results: null text has no words; a document is rejected by the base rule
when short or repetitive, else by the certified rules of its stratum; null or
rare ``lang`` (beyond the MAX_STRATA most frequent labelled ones) falls in one
pooled stratum, an empty one does not; no labels means no certified rule; repeated rows stay; an empty
table gives no rows; extra columns are ignored. A document labelled twice counts
once per label row. Repeated windows are found by 64-bit hashes within a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from riskloom.functions.shared import Scope, materialize
from riskloom.llm.native import SPACES, binomial_tail, count_chars, let, words

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHA, DELTA, PRICE = 0.05, 0.05, 5
#: Strata are the most frequent labelled values; the rest share one. Bounds the broadcast.
MAX_STRATA = 255
#: Rule: signal and grid of cutoffs, loosest first.
GRID = [round(1.0 * 0.85**i, 6) for i in range(30)]
RULES = ("symbol_ratio", "upper_ratio", "bang_ratio", "bar_ratio", "dup_line_ratio", "repeat_ratio")


def _windows(w: Column) -> Column:
    """Hashes of all 8-word windows, by doubling."""

    def widen(step: int):
        return lambda h: F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + step)))

    h = F.transform(w, lambda x: F.xxhash64(x))
    for step in (1, 2, 4):
        h = let(h, widen(step))
    return F.when(F.size(w) >= 8, F.slice(h, 1, F.greatest(F.size(w) - 7, F.lit(1)))).otherwise(F.array().cast("array<long>"))


def _covered(win: Column) -> Column:
    """Words in windows found twice or more."""

    def repeats(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(s, twin), lambda x: x["i"]))

    ordered = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    starts = let(ordered, repeats)
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))

    def add(acc: Column, p: Column) -> Column:
        return F.struct((acc["n"] + p + 8 - F.greatest(acc["upto"], p)).cast("int").alias("n"), (p + 8).cast("int").alias("upto"))

    total = F.aggregate(starts, zero, add, lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(win)) < F.size(win), total).otherwise(0)


def quality_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """Counts and signals per document: doc_id, text_hash, stratum, the counts and one column per rule."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    stratum = F.col(stratum_col).cast("string") if stratum_col and stratum_col in docs.columns else F.lit(None).cast("string")
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    step = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text_col).alias("text_hash"),
        stratum.alias("stratum"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        count_chars(text, SYMBOLS).cast("long").alias("n_symbols"),
        count_chars(text, UPPER).alias("upper"),
        count_chars(text, "!").alias("bangs"),
        count_chars(text, "|").alias("bars"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("d"))).alias("lines"),
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _windows(w).alias("win"))).alias("w"),
    )
    step = step.select("*", _covered(F.col("w.win")).cast("long").alias("n_repeat_words"))
    per_char, per_word = F.greatest(F.col("word_chars"), F.lit(1)), F.greatest(F.col("w.n"), F.lit(1))
    return step.select(
        "doc_id",
        "text_hash",
        "stratum",
        F.col("w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("lines.n") - F.col("lines.d")).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.col("n_symbols") / per_char).alias("symbol_ratio"),
        (F.col("upper") / per_char).alias("upper_ratio"),
        (F.col("bangs") / per_word).alias("bang_ratio"),
        (F.col("bars") / per_word).alias("bar_ratio"),
        ((F.col("lines.n") - F.col("lines.d")) / F.greatest(F.col("lines.n"), F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / per_word).alias("repeat_ratio"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def certified_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Per stratum and rule the chosen cutoff: (stratum, rule, cutoff, n_good, good_rejected, bad_rejected, p_value).

    ``labelled`` has the signals, ``stratum`` and ``quality`` (1 good, 0 bad).
    """
    per_rule = alpha / len(RULES)
    grid = F.array(*[F.lit(c) for c in GRID])
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("x")) for r in RULES])
    # a document is rejected by the cutoffs from the first one below its signal on
    counts = (
        labelled.where("quality is not null and not base_failed")
        .select("stratum", "quality", F.explode(rules).alias("r"))
        .select("stratum", "quality", "r.rule", F.size(F.filter(grid, lambda c: c >= F.col("r.x"))).alias("step"))
        .groupBy("stratum", "rule", "step")
        .agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    )
    strata = counts.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"))
    steps = F.explode(F.sequence(F.lit(0), F.lit(len(GRID) - 1))).alias("step")
    full = strata.select("stratum", "rule", "n_good", steps).join(counts, ["stratum", "rule", "step"], "left").na.fill(0, ["good", "bad"])
    by = Window.partitionBy("stratum", "rule").orderBy("step")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    full = full.select("stratum", "rule", "step", "n_good", F.sum("good").over(upto).alias("good_rejected"), F.sum("bad").over(upto).alias("bad_rejected"))
    level = F.lit(delta) / (len(RULES) * F.greatest(F.lit(1), F.col("strata")))
    n_strata = strata.agg(F.count_distinct("stratum").alias("strata"))
    tested = full.crossJoin(n_strata).withColumn("p_value", binomial_tail(F.col("good_rejected"), F.col("n_good"), per_rule))
    tested = tested.withColumn("passed", F.min((F.col("p_value") <= level).cast("int")).over(upto))
    gain = F.col("bad_rejected") - PRICE * F.col("good_rejected")
    best = Window.partitionBy("stratum", "rule").orderBy(gain.desc(), "step")
    chosen = tested.where("passed = 1").withColumn("place", F.row_number().over(best)).where((F.col("place") == 1) & (gain > 0))
    return chosen.select("stratum", "rule", F.get(grid, F.col("step")).alias("cutoff"), "n_good", "good_rejected", "bad_rejected", "p_value")


def _verdicts(docs: DataFrame, labels: DataFrame, alpha: float, delta: float, columns: dict) -> DataFrame:
    """``quality_verdicts`` on materialized tables of the scope around."""
    signals = quality_signals(docs, **columns).withColumn("base_failed", base_failed())
    signals = materialize(signals, "quality-signals")
    marks = labels.where("quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    labelled = signals.join(marks, "doc_id")
    common = labelled.groupBy("stratum").count().where("stratum is not null").orderBy(F.desc("count"), "stratum").limit(MAX_STRATA)
    # own strata are marked, so that an empty name is not the pooled one
    common = F.broadcast(common.select("stratum", F.concat(F.lit("="), "stratum").alias("own")))
    pooled = lambda df: df.join(common, "stratum", "left").withColumn("stratum", F.coalesce("own", F.lit(""))).drop("own")
    cuts = certified_cutoffs(pooled(labelled), alpha, delta)
    cuts = cuts.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))
    cuts = materialize(cuts, "quality-cuts")  # at most MAX_STRATA + 1 rows
    judged = pooled(signals).join(F.broadcast(cuts), "stratum", "left")
    hits = F.filter(F.array(*[F.when(F.col(r) > F.col("cuts")[r], F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    judged = judged.withColumn("rejected_by", hits)
    return judged.drop("cuts").withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def quality_verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, **columns) -> DataFrame:
    """Signals of every document with ``base_failed``, ``kept`` and the rules that rejected it."""
    with Scope() as done:
        return done(_verdicts(docs, labels, alpha, delta, columns))


def quality_report(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, **columns) -> DataFrame:
    """Counts and verdict per document."""
    shown = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    with Scope() as done:
        return done(_verdicts(docs, labels, alpha, delta, columns).select(*shown))


def filter_quality(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, **columns) -> DataFrame:
    """The documents that pass, with all their columns."""
    with Scope() as done:
        verdicts = _verdicts(docs, labels, alpha, delta, columns)
        kept = done(verdicts.where("kept").select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash")).distinct(), "quality-kept")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    match = rows["id"].eqNullSafe(kept["key_id"]) & (rows["hash"] == kept["key_hash"])
    return rows.join(kept, match, "left_semi").select("row.*")
