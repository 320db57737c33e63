"""Stored data tables, and a catalogue of their columns.

A table is stored as it is, text columns and repeated index values included, below
``tables/accession=.../assay_name=.../filename=...``, with the number of each row in the
file. The catalogue holds a row per column, so a query can match column names and choose
tables without touching any data; it then reads the chosen columns of the chosen tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("accession", "assay_name", "filename")
ROW = "_row"
CATALOGUE = "accession string, assay_name string, filename string, place int, column string, type string"


@dataclass(frozen=True)
class TableStore:
    """Tables below a folder."""

    spark: SparkSession
    root: str

    def path(self, accession: str, assay_name: str, filename: str) -> str:
        parts = zip(KEY, (accession, assay_name, filename))
        return "/".join([f"{self.root}/tables", *[f"{k}={quote(v, safe='')}" for k, v in parts]])

    def store(self, df: DataFrame, accession: str, assay_name: str, filename: str) -> None:
        """Store one table, whose first column is the index; again replaces it.

        Rows keep the order they are read in. The catalogue rows come last, so a table
        that is not stored to its end is not found.
        """
        numbered = df.withColumn(ROW, F.monotonically_increasing_id())
        numbered.write.mode("overwrite").parquet(self.path(accession, assay_name, filename))
        rows = [
            (accession, assay_name, filename, k, f.name, f.dataType.simpleString())
            for k, f in enumerate(df.schema)
        ]
        listed = self.spark.createDataFrame(rows, CATALOGUE).drop("accession").coalesce(1)
        name = "/".join(f"{k}={quote(v, safe='')}" for k, v in (("accession", accession), ("table", f"{assay_name}/{filename}")))
        listed.write.mode("overwrite").parquet(f"{self.root}/catalogue/{name}")

    def columns(self) -> DataFrame:
        """(accession, assay_name, filename, place, column, type) of all stored columns."""
        schema = f"{CATALOGUE}, `table` string"
        return self.spark.read.schema(schema).parquet(f"{self.root}/catalogue").drop("table")

    def read(self, accession: str, assay_name: str, filename: str) -> DataFrame:
        """One table with the number of each row."""
        return self.spark.read.parquet(self.path(accession, assay_name, filename))
