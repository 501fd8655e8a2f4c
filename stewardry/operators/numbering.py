"""Dense running numbers per key that no single task has to produce."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

PART_BITS = 33  # monotonically_increasing_id keeps the partition above this bit


def ordered_positions(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows range-sorted by key and order over the cluster, with a fixed 64-bit ``_pos``.

    A hot key spreads over as many ranges as its rows need. Positions depend on the
    partitioning, so the rows are written before anybody uses them. ``order`` must be total.
    """
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return materialize(ranged.withColumn("_pos", F.monotonically_increasing_id()))


def number_within(
    df: DataFrame, keys: list[str], order: list[str], name: str = "n"
) -> DataFrame:
    """Add ``name`` = 1, 2, 3, ... per key in ``order``; null keys are a key of their own.

    Within a range the rows of a key lie side by side, so their numbers follow from the
    position; only one (count, first position) pair per key and range is ever grouped.
    """
    placed = ordered_positions(df, keys, order).withColumn(
        "_part", F.shiftright("_pos", PART_BITS)
    )
    runs = placed.groupBy(*keys, "_part").agg(
        F.count("*").alias("_rows"), F.min("_pos").alias("_first")
    )
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = runs.select(
        *keys,
        "_part",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    same = F.col("_part") == F.col("_own_part")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"_own{key}"))
    renamed = shifts.withColumnsRenamed({c: f"_own{c}" for c in [*keys, "_part"]})
    return (
        placed.join(renamed, same)
        .withColumn(name, F.col("_pos") + F.col("_shift"))
        .drop("_pos", "_part", "_shift")
        .select(*df.columns, name)
    )
