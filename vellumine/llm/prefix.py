"""Running sums over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BLOCK = 50_000


def shuffled_order(*columns: str | Column) -> Column:
    """A fixed pseudo-random order of rows, in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def running_sum(df: DataFrame, group: str, order: str, size: str, out: str, n_rows: int) -> DataFrame:
    """The rows with the sum of ``size`` over the rows of their group that come before them.

    ``order`` lies in [0, 1). It is cut into blocks of some ``ROWS_PER_BLOCK`` rows, so that a group
    with most of the rows is summed by many tasks: inside the blocks, and over the blocks' totals.
    Ties in the order are broken by the row's hash.
    """
    blocks = max(1, n_rows // ROWS_PER_BLOCK)
    df = df.withColumn("_block", F.floor(F.col(order) * blocks).cast("long"))
    totals = df.groupBy(group, "_block").agg(F.sum(size).alias("_total"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    within = Window.partitionBy(group, "_block").orderBy(order, F.xxhash64(*[c for c in df.columns if c != "_block"])).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_within", F.coalesce(F.sum(size).over(within), F.lit(0)))
    rows = rows.alias("r").join(totals.drop("_total").alias("t"), F.col(f"r.{group}").eqNullSafe(F.col(f"t.{group}")) & (F.col("r._block") == F.col("t._block")))
    return rows.select("r.*", (F.col("_within") + F.col("_before")).alias(out)).drop("_block", "_within")
