"""Events, prompts, reports and their parts; model back ends are plain callables with offline defaults."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# ---- fixed values: the parts of a report and their titles
SECTIONS = {
    "critical_entities": "Critically Exposed Entities", "dependency_chains": "Cascade & Dependency Chains", "critical_edges": "Single-Source Critical Dependencies",
    "mitigations": "Mitigation Recommendations", "resilience_assessment": "Supply Chain Resilience Assessment",
}

Embedder = Callable[[list[str]], np.ndarray]
Writer = Callable[[str], str]


@dataclass(frozen=True)
class DisruptionEvent:
    """A shock to named nodes."""

    name: str
    ground_zero: tuple[str, ...]
    initial_shock: float
    category: str
    description: str = ""
    affected_region: str | None = None

    def __post_init__(self):
        if not self.ground_zero:
            raise ValueError("ground_zero must name a node")
        if not 0 <= self.initial_shock <= 1:
            raise ValueError("initial_shock must lie in [0, 1]")


def events_frame(spark, events: dict[str, DisruptionEvent]) -> DataFrame:
    """(scenario, ground_zero, shock, affected_region, name, category, description) for ``propagate``."""
    rows = [(k, list(e.ground_zero), e.initial_shock, e.affected_region, e.name, e.category, e.description) for k, e in events.items()]
    return spark.createDataFrame(rows, "scenario string, ground_zero array<string>, shock double, affected_region string, name string, category string, description string")


def detect_event(questions: DataFrame, events: DataFrame, order: str = "place") -> DataFrame:
    """(question, scenario): the event with most of its words in the question; ties and none: the first by ``order``.

    Words are those of the key, the name, and of the description from four letters on.
    """
    split = lambda c: F.split(F.lower(c), r"\W+")
    words = F.array_distinct(F.filter(F.concat(F.split(F.lower("scenario"), "_"), split(F.col("name")), F.filter(split(F.col("description")), lambda w: F.length(w) >= 4)), lambda w: w != ""))
    known = events.select("scenario", order, F.explode(words).alias("word"))
    scored = questions.select("question").crossJoin(F.broadcast(known))  # a stated library of events
    hit = F.regexp_like(F.lower("question"), F.concat(F.lit(r"\b\Q"), "word", F.lit(r"\E\b")))
    total = scored.groupBy("question", "scenario", order).agg(F.count_if(hit).alias("n"))
    return total.groupBy("question").agg(F.min(F.struct((-F.col("n")).alias("n"), order, "scenario")).alias("b")).select("question", F.col("b.scenario").alias("scenario"))


def hashing_embedder(dim: int = 384) -> Embedder:
    """Deterministic feature hashing of words and three-letter pieces, unit length; needs no model."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                for piece in [w, *(w[k : k + 3] for k in range(len(w) - 2))]:
                    h = int.from_bytes(hashlib.blake2b(piece.encode(), digest_size=8).digest(), "little")
                    out[i, h % dim] += 1.0 if h >> 63 else -1.0
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size == 0, 1, size)

    return embed


def embed_texts(df: DataFrame, text: str, out: str = "vector", embedder: Embedder | None = None) -> DataFrame:
    """Add unit vectors of a text column in Arrow batches."""
    embed = embedder or hashing_embedder()

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(embed(b.fillna("").tolist())))

    return df.withColumn(out, run(F.col(text)))


def extract_json(c: Column, schema: str) -> Column:
    """Objects of a model's answer: code fences go, else the outermost brackets; null on failure."""
    bare = F.regexp_replace(c, r"(?s)```(?:json)?|```", "")
    return F.coalesce(F.from_json(F.trim(bare), schema), F.from_json(F.regexp_extract(bare, r"(?s)\[.*\]", 0), schema))


def wait_seconds(c: Column) -> Column:
    """Seconds of a rate-limit text such as 2m59.5s."""
    part = lambda p: F.coalesce(F.regexp_extract(c, p, 1).try_cast("double"), F.lit(0.0))
    return part(r"(\d+(?:\.\d+)?)h") * 3600 + part(r"(\d+(?:\.\d+)?)m(?!s)") * 60 + part(r"(\d+(?:\.\d+)?)s") + part(r"(\d+(?:\.\d+)?)ms") / 1000


def section(c: Column, title: str) -> Column:
    """Text under ``## title`` up to the next header."""
    return F.trim(F.regexp_extract(c, rf"(?is)##\s*{re.escape(title)}\s*\n(.*?)(?=\n##\s|\z)", 1))


def parse_report(df: DataFrame, text: str = "full_text") -> DataFrame:
    """Add one column per report section."""
    return df.withColumns({c: section(F.col(text), t) for c, t in SECTIONS.items()})


def confidence_of_shock(shock: Column) -> Column:
    return F.when(shock >= 0.8, "HIGH").when(shock >= 0.5, "MEDIUM").otherwise("LOW")


def enriched_context(merged: DataFrame, exposures: DataFrame, n: int = 15) -> DataFrame:
    """(place, line): the most relevant and exposed nodes, worst first (a report of n lines)."""
    rows = merged.join(exposures.withColumnRenamed("node", "name"), "name", "left").orderBy(F.desc("merged"), "name").limit(n)
    badge = F.when(F.col("severity").isNotNull(), F.concat(F.lit(" ["), F.upper("severity"), F.lit("]"))).otherwise("")
    via = F.when(F.size("path") > 1, F.concat(F.lit(" via "), F.array_join("path", " > "))).otherwise("")
    swap = F.when(F.coalesce("has_alternative", F.lit(False)), " (alternative available)").otherwise("")
    return rows.select("name", "merged", F.concat("name", badge, via, swap).alias("line"))


def template_report(event: DisruptionEvent, lines: list[str]) -> str:
    """The offline report writer: every section from the given context lines."""
    some = lambda rows, none: "\n".join(f"- {x}" for x in rows) or none
    head = f"{event.name}: shock {event.initial_shock:.2f} ({event.category}). {event.description}".strip()
    level = "HIGH" if event.initial_shock >= 0.8 else "MEDIUM" if event.initial_shock >= 0.5 else "LOW"
    swaps = [f"switch: {x.split(' ')[0]}" for x in lines if "alternative available" in x]
    body = {
        "critical_entities": some(lines, "- none"), "dependency_chains": some([x for x in lines if " via " in x], "- none"),
        "critical_edges": some([x for x in lines if "[CRITICAL]" in x and "alternative available" not in x], "- none"),
        "mitigations": some(swaps, "- no alternative is known"), "resilience_assessment": f"{level}\n{head}",
    }
    return "\n\n".join(f"## {t}\n{body[c]}" for c, t in SECTIONS.items())


def report_prompt(event: DisruptionEvent, lines: list[str], question: str | None = None) -> str:
    """The prompt for a report writer: what to answer, from which context, under which sections."""
    question = question or f"What does {event.name} do to the supply chain, who is most exposed and along which paths?"
    rules = "Name the most exposed entities with their scores and paths, edges without alternative, and mitigations. Use nothing but the context."
    return "\n".join([rules, "", "Context:", *(lines or ["(empty)"]), "", f"Event: {event.name} ({event.category}), shock {event.initial_shock:.2f}", f"Question: {question}", "", *[f"## {t}" for t in SECTIONS.values()]])


class SemanticCache:
    """Reports by question in an append-only table; a question hits the most similar stored one at or over ``least``."""

    SCHEMA = "id string, query string, event string, report string, vector array<double>"

    def __init__(self, spark, path: str, embedder: Embedder | None = None, least: float = 0.92):
        self.spark, self.path, self.embedder, self.least = spark, path, embedder or hashing_embedder(), least

    def _folder(self):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def entries(self) -> DataFrame:
        system, folder = self._folder()
        return self.spark.read.schema(self.SCHEMA).parquet(self.path) if system.exists(folder) else self.spark.createDataFrame([], self.SCHEMA)

    def lookup(self, queries: DataFrame) -> DataFrame:
        """(query, id, score, report) of the questions (query) that hit."""
        asked = embed_texts(queries.select("query"), "query", "qvec", self.embedder)
        return cached(self.entries(), asked, self.least)

    def store(self, query: str, event: str, report: str) -> None:
        vector = [float(x) for x in self.embedder([query])[0]]
        key = hashlib.sha256(f"{query}\n{event}\n{report}".encode()).hexdigest()
        self.spark.createDataFrame([(key, query, event, report, vector)], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def size(self) -> int:
        return self.entries().count()

    def clear(self) -> None:
        system, folder = self._folder()
        system.delete(folder, True)


def cached(cache: DataFrame, queries: DataFrame, least: float = 0.92) -> DataFrame:
    """Best cache entry (id, vector, report) of each query (query, qvec) at or over ``least``."""
    from riskloom.operators.vectors import search

    hits = search(cache.select("id", "vector"), queries, 1, least)
    return hits.join(cache.select("id", "report"), "id")
