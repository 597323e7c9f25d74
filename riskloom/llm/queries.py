"""The registered queries of the llm operators, one per operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from riskloom.llm.ann import nearest
from riskloom.llm.chat import chat_digests, format_chats
from riskloom.llm.jaccard import jaccard_components
from riskloom.llm.mixing import mixing_plan
from riskloom.llm.oracle import CHAT_SQL, QUALITY_SQL
from riskloom.llm.packing import pack_documents
from riskloom.llm.pii import find_pii
from riskloom.llm.quality import quality_report
from riskloom.llm.scoring import score_documents
from riskloom.llm.tokens import prefix_token_counts
from riskloom.llm.toxicity import score_toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest by inner product of every vector whose id is divisible by 20."""
    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_masked_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of every whole document."""
    return score_documents(_read(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, similarity 0.85, over every whole document."""
    return jaccard_components(_read(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact counts at every prefix of every whole document, packed; cut_chars answers the limit of 2048."""
    counts = prefix_token_counts(_read(spark, sf_dir, "documents"), "word_bpe_49k.json", limit=2048, store="packed")
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "cut_chars", "prefix_tokens")


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and those the weakly supervised classifier adds, over every whole document."""
    return find_pii(_read(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(_read(spark, sf_dir, "documents"), "word_bpe_49k.json")


def _held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole document; rows with crc32(doc_id) mod 3 = 1 teach nothing."""
    scores = score_toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), ~_held_out())
    return scores.select("doc_id", _held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plan that repeats no source more than twice as often as another and loses no document."""
    return mixing_plan(_read(spark, sf_dir, "documents"), max_repeats=2.0)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and certified cutoffs per language over every whole document."""
    return quality_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more whose texts are control strings."""
    stored = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).selectExpr(
        "cast(-1 as bigint) as conv_id", "id as turn", "if(id = 0, 'user', 'assistant') as role", "'</s>[INST] ok [/INST]' as text"
    )
    return chat_digests(format_chats(stored.unionByName(planted)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": op1_nearest_neighbours,
    "op2_masked_likelihood": op2_masked_likelihood,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_token_counts": op4_token_counts,
    "op5_pii_spans": op5_pii_spans,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_toxicity": op7_toxicity,
    "op8_mixing": op8_mixing,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_format": op10_chat_format,
}
ORACLE_SQL: dict[str, str] = {"op9_quality_rules": QUALITY_SQL, "op10_chat_format": CHAT_SQL}
