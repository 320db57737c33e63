"""Positions in a total order, computed without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylens.session import shared_folder

FEW = 1_000  # rows that every task may get by hint, such as records or headers
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the lower 33 bits


def join_back(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Join a frame with a per-key frame derived from it; NULL keys match as well."""
    renamed = right.select(
        *[
            F.col(f"`{c}`").alias(f"_key_{c}" if c in keys else c)
            for c in right.columns
        ]
    )
    condition = reduce(
        lambda a, b: a & b,
        [F.col(f"`{k}`").eqNullSafe(F.col(f"`_key_{k}`")) for k in keys],
    )
    return left.join(renamed, condition, how).drop(*[f"_key_{k}" for k in keys])


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """The frame, worked out and counted once; one of at most ``most`` rows goes to every task.

    Adaptive execution does not broadcast a frame of few keys, as most partitions of its shuffle
    are empty: a join then puts all rows of a key into one task. Frames of more rows are left
    to it.
    """
    shared_folder(df.sparkSession)
    kept = df.checkpoint()
    return F.broadcast(kept) if kept.count() <= most else kept


def with_position(
    df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), name: str = "pos"
) -> DataFrame:
    """Add the 0-based position of each row in ``order`` (inside ``group``, if given).

    Rows are range-partitioned on (group, order), so a group holding most of the
    rows spans many partitions. The sorted rows are checkpointed once, because the
    boundaries must not be drawn again. Each (group, partition) then adds the
    number of rows its group has in earlier partitions; only those counts meet.
    """
    shared_folder(df.sparkSession)
    keys = [F.col(f"`{g}`") for g in group]
    placed = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_pos_row", F.monotonically_increasing_id())
        .withColumn("_pos_part", F.shiftright("_pos_row", _ROW_BITS))
        .withColumn("_pos_row", F.col("_pos_row").bitwiseAND(F.lit(2**_ROW_BITS - 1)))
        .checkpoint()
    )
    by = [*group, "_pos_part"]
    spans = placed.groupBy(*[f"`{g}`" for g in by]).agg(
        F.count(F.lit(1)).alias("_pos_n"), F.min("_pos_row").alias("_pos_first")
    )
    # at most one row per range partition and group reaches this window
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("_pos_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    spans = spans.withColumn("_pos_before", F.coalesce(F.sum("_pos_n").over(earlier), F.lit(0)))
    if not keys:
        spans = F.broadcast(spans)  # a row per range partition
    position = F.col("_pos_row") - F.col("_pos_first") + F.col("_pos_before")
    kept = [F.col(f"`{c}`") for c in df.columns]
    return join_back(placed, spans, by).select(*kept, position.cast("bigint").alias(name))
