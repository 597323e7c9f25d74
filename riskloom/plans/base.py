"""Registration of queries with the DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.functions.shared import materialize
from riskloom.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def graph_sql(select: str, *more: str, recursive: bool = False) -> str:
    """A query over the fixture graph; ``more`` are further common table expressions."""
    ctes = ",\n".join([fixtures.GRAPH_CTES.strip(), *more])
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the fixture graph; the edges are computed once."""
    return fixtures.supply_nodes(spark, sf_dir), materialize(fixtures.supply_edges(spark, sf_dir), "edges")
