"""Mixing sources by temperature over word counts, in SQL expressions only.

A source's share of tokens p is raised to an exponent a and normalised: w = p^a / sum p^a.
a = 1 keeps the corpus as it is, a = 0 weighs sources alike. The exponent is bisected
(PROBES points a pass, one distributed aggregate over the per-source totals each) to
meet a target entropy, or the smallest one whose weights repeat no source more often than a limit.
The weights are then realised within a token budget: every source is dealt into blocks
of about BLOCK_TOKENS (at most MAX_BLOCKS, larger ones then), and each epoch is a permutation of blocks and of the documents inside
them; a source gives whole epochs and the first part of a last one until its quota
is met (overshooting by less than one document). ``mix_key`` orders the result so that every
prefix holds about the target weights.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` here, counted natively, plus one per document.
Without a budget it is the least one at which every source runs at least one whole
epoch, so no document is lost.

Scale: only (doc_id, source, tokens) rows are shuffled for the plan; running sums are per
block, with one row a block above them, so a source holding a third of the corpus is
spread over its blocks.

Defined results: null text counts one token; a null source is a source of its own, apart from an empty one; repeated
rows (equal id and text) are ordered by their other columns and each kept as often as its place
says; an empty table gives no rows; ``mix_documents`` keeps all columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from riskloom.functions.shared import Scope, materialize
from riskloom.llm.native import SPACES

BLOCK_TOKENS, MAX_BLOCKS = 250_000, 20_000
PROBES = 15
#: Cells into which equal rows are dealt to be numbered, so that many of them do not meet in one task.
TWIN_CELLS = 256


def source_totals(rows: DataFrame) -> DataFrame:
    """(source, tokens, docs, share) of narrow rows (source, n_tokens)."""
    totals = materialize(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "mix-totals")
    return totals.crossJoin(totals.agg(F.sum("tokens").alias("all"))).withColumn("share", F.col("tokens") / F.col("all"))


def _measures(totals: DataFrame, exponents: list[float], budget: float | None) -> list[tuple[float, float]]:
    """(entropy, greatest repetition) of the weights at each exponent; only scalars reach the driver."""
    p = F.col("share")
    wanted = []
    for i, a in enumerate(exponents):
        wanted += [F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"s{i}")]
        wanted += [F.max(F.pow(p, F.lit(a - 1.0))).alias(f"hi{i}"), F.min(F.pow(p, F.lit(a - 1.0))).alias(f"lo{i}")]
    r = totals.agg(*wanted, F.max("all").alias("all")).first()
    out = []
    for i, a in enumerate(exponents):
        z = r[f"z{i}"]
        repeats = r[f"hi{i}"] / r[f"lo{i}"] if budget is None else r[f"hi{i}"] / z * budget / r["all"]
        out.append((math.log(z) - a * r[f"s{i}"] / z, repeats))
    return out


def solve_exponent(totals: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> float:
    """The exponent in [0, 1] that meets the target; both measures fall as it grows.

    The nearer end is returned when the target lies outside what [0, 1] can reach.
    """
    if (target_entropy is None) == (max_repeats is None):
        raise ValueError("give either target_entropy or max_repeats")
    low, high = 0.0, 1.0
    over = (lambda m: m[0] > target_entropy) if target_entropy is not None else (lambda m: m[1] > max_repeats)
    for _ in range(8):
        points = [low + (high - low) * i / (PROBES + 1) for i in range(PROBES + 2)]
        above = sum(over(m) for m in _measures(totals, points, budget))
        if above in (0, len(points)):
            return points[0] if above == 0 else points[-1]
        low, high = points[above - 1], points[above]
    return high


def _plan(docs: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: float | None, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): the narrow rows of ``docs`` and ``mixing_plan``, on materialized tables of the scope around."""
    count = F.coalesce(F.regexp_count("text", F.lit(f"[^{SPACES}]+")), F.lit(0)) + 1
    name = F.col("source").cast("string")
    # a null source apart from an empty one
    key = F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), key.alias("source"), count.cast("long").alias("n_tokens"))
    rows = materialize(rows, "mix-rows")
    totals = source_totals(rows)
    if rows.isEmpty():
        exponent = 1.0
    else:
        exponent = solve_exponent(totals, target_entropy, max_repeats, budget)
    power = F.pow("share", F.lit(exponent))
    sums = totals.agg(F.sum(power).alias("z"), F.max(F.col("tokens") / power).alias("least"))
    quotas = totals.crossJoin(sums).withColumn("weight", power / F.col("z"))
    whole = F.lit(float(budget)) if budget is not None else F.col("least") * F.col("z")
    # a quota of whole epochs must not lose its last document to rounding
    quota = F.col("weight") * whole
    near = F.round(quota / F.col("tokens")) * F.col("tokens")
    quota = F.when(F.abs(quota - near) < 1e-9 * near, near).otherwise(quota)
    quotas = quotas.select("source", "tokens", "weight", quota.alias("quota"), F.ceil(F.least(F.col("tokens") / BLOCK_TOKENS, F.lit(MAX_BLOCKS))).alias("blocks"))
    quotas = materialize(quotas, "mix-quotas")

    mark = lambda *c: F.xxhash64(*c, F.lit(seed))
    dealt = rows.join(quotas, "source").withColumn("block", F.pmod(mark("doc_id", "text_hash"), F.col("blocks")))
    sizes = dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("size"), F.first("tokens").alias("tokens"), F.first("quota").alias("quota"))
    epochs = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("quota") / F.col("tokens")).cast("int") - 1, F.lit(0)))).alias("epoch")
    sizes = sizes.select("*", epochs)
    before = Window.partitionBy("source", "epoch").orderBy(mark("source", "block", "epoch"), "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.col("epoch") * F.col("tokens") + F.coalesce(F.sum("size").over(before), F.lit(0)))
    starts = starts.where("start < quota").select("source", "block", "epoch", "start")
    inside = Window.partitionBy("source", "block", "epoch").orderBy(mark("doc_id", "epoch"), "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(starts, ["source", "block"]).withColumn("at", F.col("start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    shown = F.when(F.col("source") != "", F.substr("source", F.lit(2)))
    plan = placed.where("at < quota").select(
        "doc_id", "text_hash", shown.alias("source"), "n_tokens", "epoch", "block", (F.col("at") / F.col("quota")).alias("mix_key"), "weight"
    )
    return rows, plan


def mixing_plan(
    docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, seed: int = 0
) -> DataFrame:
    """One row per document and epoch that is used: doc_id, text_hash, source, n_tokens, epoch, block, mix_key, weight."""
    with Scope() as done:
        return done(_plan(docs, target_entropy, max_repeats, budget, seed)[1])


def mix_documents(
    docs: DataFrame, target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None, seed: int = 0
) -> DataFrame:
    """The documents, each as often as the plan uses it, with all their columns."""
    with Scope() as done:
        narrow, plan = _plan(docs, target_entropy, max_repeats, budget, seed)
        # a row of the plan stands for one row of the table: number equal rows on both sides by epoch
        used = plan.groupBy("doc_id", "text_hash", "epoch").agg(F.count("*").alias("n"))
        have = narrow.groupBy("doc_id", "text_hash").agg(F.lit(-1).alias("epoch"), F.count("*").alias("n"))
        copies = used.unionByName(have).groupBy(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash")).agg(
            F.max(F.when(F.col("epoch") < 0, F.col("n"))).alias("rows"), F.sort_array(F.collect_list(F.when(F.col("epoch") >= 0, F.col("n"))), asc=False).alias("uses")
        )
        copies = done(copies, "mix-copies")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    keys = copies.hint("merge")
    joined = rows.join(keys, rows["id"].eqNullSafe(keys["key_id"]) & (rows["hash"] == keys["key_hash"]))
    # the i-th of equal rows is used in the epochs that use at least i of them
    single = joined.where("rows = 1").select("row", F.size("uses").alias("times"))
    if not copies.where("rows > 1").isEmpty():
        twins = joined.where("rows > 1").withColumn("shown", F.to_json("row"))
        twins = twins.withColumn("cell", F.pmod(F.xxhash64("shown"), F.lit(TWIN_CELLS)))
        key = ["id", "hash"]
        cells = twins.groupBy(*key, "cell").agg(F.count("*").alias("n"))
        before = Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # at most TWIN_CELLS rows
        cells = cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumnsRenamed({"id": "cell_id", "hash": "cell_hash", "cell": "cell_no"})
        inside = Window.partitionBy(*key, "cell").orderBy("shown")
        placed = twins.withColumn("place", F.row_number().over(inside))
        same = placed["id"].eqNullSafe(cells["cell_id"]) & (placed["hash"] == cells["cell_hash"]) & (placed["cell"] == cells["cell_no"])
        placed = placed.join(cells.drop("n"), same).withColumn("place", F.col("place") + F.col("before"))
        single = single.unionByName(placed.select("row", F.size(F.filter("uses", lambda n: n >= F.col("place"))).alias("times")))
    return single.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
