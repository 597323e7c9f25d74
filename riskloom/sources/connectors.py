"""Readers and writers of the engine's file formats; model and HTTP clients stay outside.

Every reader states its schema; nothing is inferred at run time. Readers and writers take any path that
Spark can open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

TRIPLE_SCHEMA = "source string, head string, head_type string, relation string, tail string, tail_type string, confidence string, evidence string"
ENTITY_SCHEMA = "id string, name string, type string, source string, aliases array<string>, properties map<string,string>"
RELATION_SCHEMA = "id string, source_entity string, target_entity string, type string, evidence string, evidence_source string, confidence double, properties map<string,string>"
#: A day file of world events has 58 tab-separated columns; those in use, by position.
EVENT_COLUMNS = {0: "event_id", 1: "day", 7: "actor1_country", 17: "actor2_country", 26: "event_code", 28: "root", 30: "goldstein", 33: "articles", 34: "tone", 37: "actor1_geo", 44: "actor2_geo", 51: "action_geo", 57: "url"}
EVENT_WIDTH = 58


def read_documents(spark: SparkSession, path: str, kind: str, cap: int | None = None) -> DataFrame:
    """(source, text) of ``text`` files (one document each), ``json`` arrays or ``jsonl`` lines.

    A record without a source is named after its file and place. ``cap`` keeps the first records.
    """
    if kind == "text":
        raw = spark.read.text(path, wholetext=True).select(F.lit(None).cast("string").alias("source"), F.col("value").alias("text"), F.input_file_name().alias("file"))
    elif kind in ("json", "jsonl"):
        raw = spark.read.schema("source string, text string").option("multiLine", kind == "json").json(path).select("source", "text", F.input_file_name().alias("file"))
    else:
        raise ValueError(f"unknown kind {kind!r}")
    named = raw.where("text is not null").select(F.coalesce(F.nullif("source", F.lit("")), F.regexp_extract("file", r"([^/]+)$", 1)).alias("source"), "text")
    return named.limit(cap) if cap is not None else named


def read_triples(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """Triples of JSON lines or one JSON array; lines that are no objects go."""
    rows = spark.read.schema(TRIPLE_SCHEMA).option("multiLine", multiline).option("mode", "PERMISSIVE").json(path)
    return rows.where("head is not null or tail is not null")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Parquet transcripts; the text is the first of ``transcript`` and ``content`` that the files have."""
    df = spark.read.parquet(path)
    pick = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in df.columns] or [F.lit(None).cast("string")])
    out = {"text": ("transcript", "content"), "ticker": ("ticker", "symbol"), "company": ("company", "company_name"), "date": ("earnings_date", "date")}
    keep = [c for c in ("cik", "sector", "industry", "year", "quarter") if c in df.columns]
    return df.select(*[pick(*names).alias(n) for n, names in out.items()], *[F.when(F.col(c).cast("string") != "NaN", F.col(c)).alias(c) for c in keep])


def read_event_days(spark: SparkSession, path: str, countries: list[str]) -> DataFrame:
    """Rows of tab-separated day files of which any country field is watched; short rows go."""
    fields = F.split("value", "\t", -1)
    rows = spark.read.text(path).where(F.size(fields) >= EVENT_WIDTH)
    typed = rows.select(*[F.get(fields, F.lit(i)).alias(n) for i, n in EVENT_COLUMNS.items()])
    watched = F.lit(False)
    for c in ("actor1_country", "actor2_country", "actor1_geo", "actor2_geo", "action_geo"):
        watched = watched | F.col(c).isin(*countries)
    return typed.where(watched).withColumns({"goldstein": F.col("goldstein").try_cast("double"), "articles": F.col("articles").try_cast("int")})


def new_days(available: DataFrame, done: DataFrame) -> DataFrame:
    """Days not fetched yet."""
    return available.join(done, "day", "left_anti")


def filings(submissions: DataFrame, form: str, n: int) -> DataFrame:
    """(cik, form, accession, document): the first n filings of a form from parallel arrays."""
    zipped = F.posexplode(F.arrays_zip("forms", "accessions", "documents")).alias("at", "f")
    rows = submissions.select("cik", zipped).where(F.col("f.forms") == form)
    from riskloom.operators.graph import top_per_key

    return top_per_key(rows, ["cik"], ["at"], n).select("cik", F.col("f.forms").alias("form"), F.col("f.accessions").alias("accession"), F.col("f.documents").alias("document"))


def clean_country_name(c: Column) -> Column:
    """Without hard blanks, trailing footnote digits, and a footnote ``e`` after a consonant (of any name that ends so)."""
    out = F.trim(F.regexp_replace(F.trim(F.replace(c, F.lit("\u00a0"), F.lit(" "))), "[0-9,]+$", ""))
    return F.trim(F.regexp_replace(out, "([^aeiouAEIOU ])e$", "$1"))


def read_minerals(spark: SparkSession, path: str, names: dict[str, list[str]]) -> DataFrame:
    """(country, production, reserves) of CSV tables; each column is the first of its candidate headers.

    Totals go; marks for withheld or missing amounts become null.
    """
    df = spark.read.option("header", True).csv(path)
    found = {want: next((c for c in have if c in df.columns), None) for want, have in names.items()}
    value = lambda c: F.lit(None).cast("string") if c is None else F.when(~F.col(c).isin("W", "—", "-", "NA", ""), F.col(c))
    country = clean_country_name(F.col(found["country"]))
    rows = df.select(country.alias("country"), value(found.get("production")).alias("production"), value(found.get("reserves")).alias("reserves"))
    return rows.where("country <> '' and lower(country) not like '%total%'")


def guide_text(steps: Column) -> Column:
    """Flat text of nested guide steps: titles and the raw text of their lines."""
    return F.array_join(F.flatten(F.transform(steps, lambda s: F.concat(F.array(s["title"]), F.transform(s["lines"], lambda x: x["text_raw"])))), " ")


def read_records(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relationships of every source folder, each tagged with its file."""
    one = lambda name, schema: spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/{name}.json").withColumn("file", F.input_file_name())
    return one("entities", ENTITY_SCHEMA), one("relationships", RELATION_SCHEMA)


# ---- sinks
def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes and edges as Parquet, edges range-partitioned by source for later point reads."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.repartitionByRange(F.lower("src")).sortWithinPartitions(F.lower("src"), "relation", F.lower("dst")).write.mode("overwrite").parquet(f"{path}/edges")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def append_log(df: DataFrame, path: str) -> None:
    """Append processed keys; ``triples.unprocessed`` skips them on resume."""
    df.write.mode("append").json(path)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int = 200) -> None:
    """A table bucketed and sorted by a join key, so that joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_payload(df: DataFrame, path: str) -> None:
    """One JSON object per row, nested columns included."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
