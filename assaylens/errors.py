"""Errors raised by argument checks and by data checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QueryError(ValueError):
    """The request itself cannot be answered (unknown field, bad format...)."""


class DataError(RuntimeError):
    """The data break a rule (ambiguous match, duplicate field, missing tab...)."""


def guarded(value: Column, bad: Column, message: str, *details: Column) -> Column:
    """The value; the job that reads it fails with the message where ``bad`` holds.

    The check is part of the plan, so it costs no pass over the data.
    """
    shown = F.concat_ws(" ", F.lit(f"{message}:"), *[d.cast("string") for d in details])
    return F.when(bad, F.raise_error(shown)).otherwise(value)


def raise_if_any(rejects: DataFrame, message: str, show: int = 3) -> None:
    """Raise ``DataError`` with a few examples when ``rejects`` holds any row."""
    examples = rejects.limit(show).collect()
    if examples:
        listed = "; ".join(str(row.asDict()) for row in examples)
        raise DataError(f"{message}: {listed}")
