"""Cutting lineage through a folder that every executor can read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_own: dict[str, str] = {}
_open = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only where none is set and everything runs in one process (tests)."""
    context = spark.sparkContext
    folder = context.getConf().get(CHECKPOINT_KEY, None) or spark.conf.get(CHECKPOINT_KEY, None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        app = context.applicationId
        if app not in _own:
            local = tempfile.mkdtemp(prefix="riskloom-")
            atexit.register(shutil.rmtree, local, True)
            _own[app] = f"file://{local}"
        folder = _own[app]
    return folder.rstrip("/")


def _scopes() -> list[Scope]:
    if not hasattr(_open, "scopes"):
        _open.scopes = []
    return _open.scopes


class Scope:
    """Tables that are materialized inside are deleted at its end, but for what is handed on.

    ``with Scope() as done: ... return done(result)`` writes ``result``, which may read all of them, and
    leaves only that table behind; it belongs to the scope around, if there is one.
    """

    def __init__(self):
        self.tables: list[DataFrame] = []

    def __enter__(self):
        _scopes().append(self)
        return self.hand_on

    def hand_on(self, df: DataFrame, tag: str = "result") -> DataFrame:
        out = materialize(df, tag)
        self.tables = [t for t in self.tables if t is not out]
        outer = _scopes()[: _scopes().index(self)]
        if outer:
            outer[-1].tables.append(out)
        return out

    def __exit__(self, *error) -> None:
        _scopes().remove(self)
        for t in self.tables:
            release(t)


def materialize(df: DataFrame, tag: str = "step") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a reader of it.

    The rows are computed once, survive a lost executor and have no lineage.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/riskloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._riskloom_path = path
    if _scopes():
        _scopes()[-1].tables.append(out)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``; only when nothing reads it any more."""
    path = getattr(df, "_riskloom_path", None)
    if path:
        _delete(df.sparkSession, path)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps, which it keeps until the driver's JVM collects garbage."""
    spark.sparkContext._jvm.System.gc()


def sweep(spark: SparkSession) -> None:
    """Delete every table this application has materialized; results that were not saved elsewhere go too."""
    _delete(spark, f"{shared_folder(spark)}/riskloom/{spark.sparkContext.applicationId}")
