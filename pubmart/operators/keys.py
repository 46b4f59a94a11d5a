"""Surrogate keys 1..n in natural-key order, without one global sort task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pubmart.session import ensure_checkpoint_dir, shuffles_removed

_ROWS_BITS = 33  # monotonically_increasing_id keeps the row position in its low 33 bits


def ordered_keys(rows: DataFrame, natural_key: tuple[str, ...], name: str) -> DataFrame:
    """Add ``name`` = position of the row in natural-key order.

    Rows are range-partitioned and sorted, so a row's position is its place in its partition
    plus the sizes of the partitions before. The partitioned rows are checkpointed to shared
    storage first: range bounds come from a sample and would differ between the count and the
    numbering if either were computed again, also after the loss of an executor.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    with shuffles_removed(rows.sparkSession):
        placed = (
            rows.repartitionByRange(*natural_key)
            .sortWithinPartitions(*natural_key)
            .withColumn("_place", F.monotonically_increasing_id())
            .checkpoint()
        )
    part = F.shiftright("_place", _ROWS_BITS).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_size"))
    # One row per partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    position = F.col("_before") + F.col("_place").bitwiseAND((1 << _ROWS_BITS) - 1) + 1
    numbered = placed.withColumn("_part", part).join(offsets, "_part")
    return numbered.select(position.alias(name), *rows.columns)
