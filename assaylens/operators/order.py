"""Natural ordering of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.functions.text import collated_key, natural_key

ID_COLUMNS = ("accession", "assay_name", "sample_name")


def natural_order(
    columns: Sequence[str], ascending: Sequence[bool] | None = None, collated: bool = False
) -> list[Column]:
    """Sort expressions: digit runs compare as numbers; missing values come first
    when ascending and last when descending. The raw texts break ties. Letters compare
    without case, or, if ``collated``, by Unicode collation."""
    flags = list(ascending) if ascending is not None else [True] * len(columns)
    if len(flags) != len(columns):
        raise ValueError("one direction per column is needed")
    keys, ties = [], []
    for column, up in zip(columns, flags):
        text = F.col(f"`{column}`").cast("string")
        key = collated_key(text) if collated else natural_key(text)
        keys.append(key.asc_nulls_first() if up else key.desc_nulls_last())
        ties.append(text.asc_nulls_first() if up else text.desc_nulls_last())
    return keys + ties


def sort_by_id(df: DataFrame, columns: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Sort by the id columns the frame has, in natural order."""
    return df.orderBy(*natural_order([c for c in columns if c in df.columns]))


def sort_naturally(
    df: DataFrame, columns: Sequence[str], ascending: Sequence[bool] | None = None, collated: bool = False
) -> DataFrame:
    """Sort by several columns, each in its own direction."""
    return df.orderBy(*natural_order(columns, ascending, collated))
