"""All registered queries of the graph-analytics operators and their DuckDB counterparts."""

from riskloom.plans import building, evaluation, events, knowledge, more, retrieval, simulation, text  # noqa: F401
from riskloom.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
