"""Numbering the rows of large groups in many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from riskloom.functions.shared import materialize


def number_rows(df: DataFrame, by: str, order: list[str], out: str) -> DataFrame:
    """Rows numbered from 1 in ``order`` within each ``by`` (null is a group too).

    Ranges of the order are numbered apart and moved by the group's rows in the ranges before, so no group
    meets in one task unless its rows tie. The ranges are written once, since they come from samples.
    """
    ranged = materialize(df.repartitionByRange(by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_at")).agg(F.count("*").alias("_n"))  # a row for each group and range
    earlier = F.sum("_n").over(Window.partitionBy("_by").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("_by", "_at", F.coalesce(earlier, F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(by, "_range").orderBy(*order))
    numbered = ranged.withColumn("_place", place)
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_at"))
    return numbered.join(before, same).withColumn(out, F.col("_place") + F.col("_before")).drop("_by", "_at", "_before", "_place", "_range")
