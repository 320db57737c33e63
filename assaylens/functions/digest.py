"""Content fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_digest(*columns: Column) -> Column:
    """SHA-256 of the named values of one row."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def set_fingerprint(*columns: Column) -> Column:
    """Aggregate: fingerprint of a bag of rows, whatever their order.

    The row digests are added up in four 60-bit slices. The sums combine on
    the map side, so no group is ever gathered in one place.
    """
    digest = row_digest(*columns)
    slices = [
        F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
        for i in range(4)
    ]
    parts = [F.count(F.lit(1)).cast("string"), *(s.cast("string") for s in slices)]
    return F.sha2(F.concat_ws("|", *parts), 256)
