"""Global row numbers without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from vellumine.session import cut

_PLACE_BITS = 33  # of monotonically_increasing_id: the place in the partition; the partition is above


def with_row_number(df: DataFrame, order: str | list[str], out: str) -> DataFrame:
    """The rows with their 0-based place in the order of one or more columns; nulls first, ties by the row's hash.

    Rows are range-partitioned on the order and the hash, so a value that many rows share is divided
    as well, and written once with a reliable checkpoint: every later use sees the same partitions.
    A row's number is its place in its partition plus the rows before that partition, one row each.
    No rows give no numbers; rows equal in every column are interchangeable.
    """
    keys = [order] if isinstance(order, str) else list(order)
    hashed = [f.name for f in df.schema if not isinstance(f.dataType, (MapType, VariantType))]
    by = [*keys, "_tie"]
    sorted_ = df.withColumn("_tie", F.xxhash64(*hashed)).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    rows = cut(sorted_).withColumn("_i", F.monotonically_increasing_id())
    rows = rows.withColumn("_p", F.shiftright("_i", _PLACE_BITS)).withColumn("_i", F.col("_i") - F.shiftleft("_p", _PLACE_BITS))
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    starts = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    return rows.join(F.broadcast(starts), "_p").withColumn(out, F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")
