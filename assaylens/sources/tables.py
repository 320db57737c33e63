"""Delimited data tables: reading, checking, loading."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylens.errors import DataError
from assaylens.sources.store import write_datasets

DELIMITERS = ",\t;|"
SNIFFED = 100  # lines that a delimiter is guessed from, unless the caller says otherwise


def sniff_delimiter(spark: SparkSession, path: str, n_lines: int = SNIFFED) -> str:
    """The delimiter whose count is the same, and highest, in the first ``n_lines``.

    It is a guess from the beginning of one file; ``read_table`` makes sure that all files
    have more than one column with it. Compressed files are recognised by their suffix, as
    everywhere in Spark.
    """
    lines = [r["value"] for r in spark.read.text(path).limit(n_lines).collect()]
    lines = [line for line in lines if line]
    best, best_count = None, 0
    for candidate in DELIMITERS:
        counts = {line.count(candidate) for line in lines}
        if len(counts) == 1 and (count := counts.pop()) > best_count:
            best, best_count = candidate, count
    if best is None:  # quoted cells may hold the delimiter: take the commonest in the header
        best = max(DELIMITERS, key=lines[0].count) if lines else None
        if best is None or best not in lines[0]:
            raise DataError(f"no delimiter found; say which one separates the columns of {path}")
    return best


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    index_name: str | None = None,
    schema: T.StructType | None = None,
    sep: str | None = None,
) -> DataFrame:
    """Wide table whose first column is the index.

    The index takes its name from the header, else from ``index_name``, else it is
    ``index``. With a schema every file must have exactly its columns. Without one
    the index is text and the other columns are read as whole numbers, as numbers, or
    as text, whichever all values of a column are (one pass over the files finds out).
    Files whose header differs from the first one's, in names or in number, are an error.
    """
    first = path if isinstance(path, str) else path[0]
    paths = [path] if isinstance(path, str) else list(path)
    sep = sep or sniff_delimiter(spark, first)
    reader = spark.read.option("sep", sep).option("header", True).option("escape", '"')
    if schema is not None:
        reader = reader.schema(schema).option("enforceSchema", False).option("mode", "FAILFAST")
        df = reader.csv(paths)
    else:
        # the header of the first file, as text, is what all others must have
        names = reader.csv(first).columns
        headers = T.StructType([T.StructField("" if c == f"_c{k}" else c, T.StringType()) for k, c in enumerate(names)])
        df = reader.schema(headers).option("enforceSchema", False).option("mode", "FAILFAST").csv(paths)
        df = df.toDF(*names)
        if len(df.columns) < 2:
            raise DataError(f"a single column with the delimiter {sep!r}; say which one separates the columns of {first}")
        kinds = _column_types(df)
        df = df.select(
            F.col(f"`{df.columns[0]}`"),
            *[F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in df.columns[1:]],
        )
    index = df.columns[0]
    if index == "_c0" or not index.strip():
        df = df.withColumnRenamed(index, index_name or "index")
    return nan_to_null(df)


def _column_types(df: DataFrame) -> dict[str, str]:
    """The narrowest of bigint, double and string that all values of a column are."""
    names = df.columns[1:]
    if not names:
        return {}
    counts = []
    for c in names:
        value = F.trim(F.col(f"`{c}`"))
        given = value.isNotNull()
        # digits with a sign only: 1.0 and 1e3 are numbers, but not whole ones
        whole = value.rlike("^[+-]?[0-9]+$") & value.try_cast("bigint").isNotNull()
        counts.append(
            F.struct(
                F.count_if(given).alias("given"),
                F.count_if(given & ~whole).alias("broken"),
                F.count_if(given & value.try_cast("double").isNull()).alias("words"),
            )
        )
    row = df.agg(F.array(*counts).alias("columns")).first()

    def kind(c: dict) -> str:
        if c["words"]:
            return "string"
        return "double" if c["broken"] or not c["given"] else "bigint"

    return {name: kind(c) for name, c in zip(names, row["columns"])}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Floating-point NaN as NULL in all columns."""
    return df.select(
        *[
            F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def load_tables(
    spark: SparkSession,
    paths: Sequence[str],
    accession: str,
    ts: int,
    target: str,
    schema: T.StructType,
    sep: str = ",",
) -> None:
    """Load files of one width and header into Parquet, stamped and by accession.

    Loading an accession again replaces its rows only. The reading job compares each
    file's header with the schema, so a file that differs fails the load.
    """
    load_datasets(spark, {accession: (paths, ts)}, target, schema, sep)


def load_datasets(
    spark: SparkSession,
    datasets: Mapping[str, tuple[Sequence[str], int]],
    target: str,
    schema: T.StructType,
    sep: str = ",",
) -> None:
    """Load the files of many accessions, given with their time stamps, in one job."""
    frames = [
        read_table(spark, list(paths), schema=schema, sep=sep)
        .withColumn("accession", F.lit(accession))
        .withColumn("source_ts", F.lit(ts).cast("bigint"))
        for accession, (paths, ts) in datasets.items()
    ]
    write_datasets(reduce(DataFrame.unionByName, frames), target)


def stale_tables(source: DataFrame, stored: DataFrame, key: str = "identifier") -> DataFrame:
    """(key, ts, reason): sources never stored, stored too early, or stored twice."""
    seen = stored.groupBy(key).agg(
        F.max("ts").alias("_stored_ts"), F.count(F.lit(1)).alias("_n")
    )
    joined = source.join(seen, key, "left")
    reason = (
        F.when(F.col("_n").isNull(), "missing")
        .when(F.col("_n") > 1, "conflicting")
        .when(F.col("_stored_ts") < F.col("ts"), "outdated")
    )
    return joined.withColumn("reason", reason).filter("reason IS NOT NULL").select(
        key, "ts", "reason"
    )
