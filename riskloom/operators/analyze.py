"""One call from a question to a report: event, propagation, retrieval, merge, context, text, cache."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from riskloom.operators import report, retrieve, simulate


@dataclass
class Analysis:
    """What one question gives; the frames are lazy."""

    exposures: DataFrame
    retrieval: DataFrame
    merged: DataFrame
    context: DataFrame
    text: str


def analyze_cached(cache: report.SemanticCache, question: str, event: report.DisruptionEvent, nodes: DataFrame, edges: DataFrame, seeds: DataFrame, writer: report.Writer | None = None) -> tuple[str, bool]:
    """(report, whether it came from the cache); a new report is stored."""
    hit = cache.lookup(nodes.sparkSession.createDataFrame([(question,)], "query string")).first()
    if hit is not None:
        return hit["report"], True
    text = analyze(event, nodes, edges, seeds, writer).text
    cache.store(question, event.name, text)
    return text, False


def ablation(event: report.DisruptionEvent, question: str, expected: list[str], nodes: DataFrame, edges: DataFrame, seeds: DataFrame, writer: report.Writer | None = None) -> DataFrame:
    """(condition, coverage): the share of expected names in the reports without context, with the seeds alone, and in full."""
    write = writer or (lambda prompt: prompt)
    similar = [r["name"] for r in seeds.orderBy(F.desc("similarity"), "name").limit(8).collect()]  # at most 8
    texts = {
        "baseline": write(report.report_prompt(event, [], question)), "vector_only": write(report.report_prompt(event, similar, question)),
        "full_pipeline": analyze(event, nodes, edges, seeds, writer).text,
    }
    spark = nodes.sparkSession
    reports = spark.createDataFrame(list(texts.items()), "condition string, text string")
    names = spark.createDataFrame([(e,) for e in expected], "name string")
    hits = reports.crossJoin(F.broadcast(names)).withColumn("hit", F.contains(F.lower("text"), F.lower("name")))  # a stated list
    return hits.groupBy("condition").agg((F.count_if("hit") / F.count("*")).alias("coverage"))


def analyze(event: report.DisruptionEvent, nodes: DataFrame, edges: DataFrame, seeds: DataFrame, writer: report.Writer | None = None, lines: int = 15) -> Analysis:
    """``seeds`` are (name, similarity) of the question; ``writer`` turns a prompt into text (default: a template)."""
    spark = nodes.sparkSession
    scenario = report.events_frame(spark, {"now": event})
    state = simulate.propagate(simulate.ground_zero(scenario, nodes, edges), edges)
    exposed = simulate.exposures(state, nodes, edges)
    scores, _, _ = retrieve.retrieve(nodes, edges, seeds)
    merged = retrieve.merge_scores(scores, state.select(F.col("node").alias("name"), "score"))
    context = report.enriched_context(merged.select("name", "merged"), exposed.drop("score"), lines)
    shown = [r["line"] for r in context.orderBy(F.desc("merged"), "name").collect()]  # a report of ``lines`` lines
    text = writer(report.report_prompt(event, shown)) if writer else report.template_report(event, shown)
    return Analysis(exposed, scores, merged, context, text)
