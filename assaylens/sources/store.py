"""Parquet layout of sample rows and measurements.

Both are partitioned by accession. A query that selects samples then reads only
the datasets they are in (dynamic partition pruning), and a refresh replaces only
the datasets it rebuilt. Before writing, rows are rebalanced: small datasets share
a task, and one that holds most of the rows is split over as many tasks and files
as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

PARTITION = "accession"


def write_datasets(df: DataFrame, path: str, sort: Sequence[str] = ()) -> None:
    """Write rows by accession; datasets that occur in ``df`` are replaced.

    Rows are sorted inside each file, so that the statistics of row groups help
    filters on the ``sort`` columns.
    """
    spread = df.hint("rebalance", PARTITION).sortWithinPartitions(PARTITION, *sort)
    (
        spread.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(PARTITION)
        .parquet(path)
    )


def write_measurements(df: DataFrame, path: str) -> None:
    """Write long measurements, sorted by assay and feature."""
    write_datasets(df, path, ["assay_name", "feature"])


def write_samples(df: DataFrame, path: str) -> None:
    """Write sample rows, sorted by their ids."""
    write_datasets(df, path, ["assay_name", "sample_name"])


def write_sorted(df: DataFrame, path: str) -> None:
    """Write rows sorted by accession, in as many files as their size asks for.

    For stores of very many small datasets, where a folder for each would cost more than
    its rows. What the path held is replaced as a whole.
    """
    spread = df.hint("rebalance", PARTITION).sortWithinPartitions(PARTITION)
    spread.write.mode("overwrite").parquet(path)


def read_datasets(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows; accession stays text even where it looks like a number."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name == PARTITION else f for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(path)
