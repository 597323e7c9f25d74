"""Python workers are reused: one that goes on to another operator gives back what it remembered."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from riskloom.functions.shared import Scope

BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
_memos: dict[str, Callable[[], None]] = {}


def remember(operator: str, clear: Callable[[], None]) -> None:
    """Register how to drop the memory that an operator keeps between tasks."""
    _memos[operator] = clear


def enter(operator: str) -> None:
    """Called by a task: drop the memory of all other operators."""
    for name in [n for n in _memos if n != operator]:
        _memos.pop(name)()
    pa.default_memory_pool().release_unused()


@contextmanager
def arrow_scope(spark: SparkSession) -> Iterator[Callable[..., DataFrame]]:
    """A ``Scope`` whose jobs send Python Arrow batches of few rows and bytes, so that very long texts do not meet in
    one buffer. The session's own limits are back when it ends; what it hands on is computed inside."""
    before = {k: spark.conf.get(k, None) for k in _LIMITS}
    for k, most in _LIMITS.items():
        if before[k] is None or not before[k].isdigit() or not 0 < int(before[k]) <= most:
            spark.conf.set(k, str(most))
    try:
        with Scope() as done:
            yield done
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
