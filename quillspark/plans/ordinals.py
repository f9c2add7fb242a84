"""Dense ordinals and running sums over a total order, without a window over the whole table.

Rows are range-partitioned and sorted once and staged; each partition counts for itself, and the sums of the
partitions before it come from a table with one row per partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import cut

_PLACE = (1 << 33) - 1


def ranged(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` in order, with its partition ``_part`` and its place there ``_place``."""
    staged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    return staged.select("*", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit(_PLACE)).alias("_place")).drop("_at")


def before(parts: DataFrame, *values: Column) -> DataFrame:
    """Per partition, the sums of ``values`` over all partitions before it; one row per partition, so it is broadcast."""
    names = [f"_before_{i}" for i in range(len(values))]
    sums = parts.groupBy("_part").agg(*(F.sum(v).alias(n) for v, n in zip(values, names)))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("_part", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).cast("long").alias(n) for n in names)))


def with_ordinal(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the dense 0-based number of each row in ``order``."""
    parts = ranged(df, order)
    return parts.join(before(parts, F.lit(1)), "_part").withColumn(name, F.col("_before_0") + F.col("_place")).drop("_part", "_place", "_before_0")


def with_running_sum(df: DataFrame, order: Sequence[str], value: Column, name: str, *, ordinal: str | None = None) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before it in ``order``, and its ordinal if named."""
    parts = ranged(df.withColumn("_value", value), order)
    earlier = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    found = parts.withColumn("_inside", F.coalesce(F.sum("_value").over(earlier), F.lit(0)))
    found = found.join(before(parts, F.col("_value"), F.lit(1)), "_part").withColumn(name, (F.col("_before_0") + F.col("_inside")).cast("long"))
    if ordinal:
        found = found.withColumn(ordinal, F.col("_before_1") + F.col("_place"))
    return found.drop("_part", "_place", "_value", "_inside", "_before_0", "_before_1")
