"""Risk events: the disruption filter, and its windowed counts as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
# ---- fixed values: watched countries and root codes with their names
COUNTRIES = {
    "TW": "Taiwan", "CH": "China", "KS": "South Korea", "JA": "Japan", "MY": "Malaysia", "TH": "Thailand", "VM": "Vietnam", "SN": "Singapore", "IN": "India",
    "ID": "Indonesia", "RP": "Philippines", "GM": "Germany", "NL": "Netherlands", "US": "United States",
}
ROOTS = {"13": "Threaten", "14": "Protest/Strike", "17": "Sanction/Embargo", "18": "Assault", "19": "Armed Conflict", "20": "Mass Violence"}
#: Users stand for countries, event types for root codes.
PLACES = (*COUNTRIES, "XX", "YY")
CODES = {"error": "14", "signup": "17", "purchase": "19", "view": "04"}
MIN_CENTS, MIN_ARTICLES = 300, 3


def _map(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def country_expr() -> Column:
    return F.element_at(F.array(*map(F.lit, PLACES)), (F.col("user_id") % len(PLACES) + 1).cast("int"))


def root_expr() -> Column:
    return F.coalesce(_map(CODES, F.col("event_type")), F.lit("01"))


def risk_events(events: DataFrame) -> DataFrame:
    """Events of watched countries and codes that are severe and reported often enough; also on streams."""
    typed = events.select(
        "event_id", "ts", F.date_format("ts", "yyyyMMdd").alias("day"), root_expr().alias("root"), country_expr().alias("fips"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"), F.from_json("props", "k int")["k"].alias("articles"),
    )
    kept = typed.where(F.col("fips").isin(*COUNTRIES) & F.col("root").isin(*ROOTS) & (F.col("cents") > MIN_CENTS) & (F.col("articles") >= MIN_ARTICLES))
    return kept.withColumns({"country": _map(COUNTRIES, F.col("fips")), "label": _map(ROOTS, F.col("root"))})


def risk_stream(spark: SparkSession, folder: str, late: str = "2 days") -> DataFrame:
    """Streaming daily counts per country over event files that arrive in ``folder``."""
    events = spark.readStream.schema(EVENT_SCHEMA).parquet(folder)
    risk = risk_events(events).withWatermark("ts", late)
    return risk.groupBy(F.window("ts", "1 day"), "country").agg(F.count("*").alias("n"), F.max("cents").alias("worst"))
