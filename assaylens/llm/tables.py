"""Helpers shared by the text operators: reading, storing, row ids and words."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylens.session import scratch_path

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of text whose A-Z are lower-cased


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written once to the shared folder.

    This cuts the lineage: a lost executor costs the tasks that read the files, not
    the work that made them. The planner knows the size of what is read back.
    """
    path = scratch_path(df.sparkSession, name)
    # whole texts are stored at times: smaller files are worth the CPU time
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``stored``, and the files of the shuffles that made the rows are deleted at once.

    Else they stay until the driver's JVM happens to collect what stands for them, beside
    those of the next steps.
    """
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, None)
    conf.set(_CLEAN, "true")
    try:
        return stored(df, name)
    finally:
        if before is None:
            conf.unset(_CLEAN)
        else:
            conf.set(_CLEAN, before)


def release(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing will read again."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.stored_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that the frame does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"{base}_"
    return base


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column) -> Column:
    """The words of a text, lower-cased; none for NULL."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)
