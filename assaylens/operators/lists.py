"""Values per group, one row each, whatever the size of the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylens.operators.ranking import join_back, with_position


def listed_values(
    df: DataFrame, keys: Sequence[str], value: str, alias: str, distinct: bool = True
) -> DataFrame:
    """Sorted values per group as (keys..., n_values, position, alias); positions start at 0.

    A group is never gathered: its rows are ranged over as many tasks as they need.
    Whoever knows that the groups are small can make lists of the rows.
    """
    quoted = [f"`{k}`" for k in keys]
    values = df.select(*quoted, F.col(f"`{value}`").alias(alias)).filter(F.col(f"`{alias}`").isNotNull())
    if distinct:
        values = values.distinct()
    placed = with_position(values, [F.col(f"`{alias}`")], keys, "position")
    sizes = placed.groupBy(*quoted).agg(F.count(F.lit(1)).alias("n_values"))
    return join_back(placed, sizes, keys).select(*quoted, "n_values", "position", f"`{alias}`")
