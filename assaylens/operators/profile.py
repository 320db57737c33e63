"""Column profiles: type, least and greatest value, and whether values are missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylens.functions.text import number_text
from assaylens.operators.tables import check_same_index, index_presence, is_present

# How value types are called in a profile.
TYPE_NAMES = {
    "byte": "int",
    "short": "int",
    "integer": "int",
    "long": "int",
    "float": "float",
    "double": "float",
    "decimal": "float",
    "boolean": "bool",
}


def _kind(df: DataFrame, column: str) -> str:
    return TYPE_NAMES.get(df.schema[column].dataType.typeName(), "str")


def _clean(df: DataFrame, column: str) -> Column:
    field = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(field), field)
    return field


def _statistics(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """One struct of aggregates per column, so that a single pass serves all columns."""
    out = []
    for i, column in enumerate(columns):
        field = _clean(df, column)
        if _kind(df, column) == "str":
            low = high = F.lit(None).cast("double")
        else:
            low, high = F.min(field).cast("double"), F.max(field).cast("double")
        out.append(
            F.struct(
                F.lit(column).alias("column"),
                F.lit(_kind(df, column)).alias("kind"),
                low.alias("low"),
                high.alias("high"),
                F.count(field).alias("n_present"),
                F.count(F.lit(1)).alias("n_rows"),
                F.lit(i).alias("place"),
            ).alias(f"s{i}")
        )
    return out


def _describe(stats: DataFrame, has_nan: Column) -> DataFrame:
    """Name the type and write ``type[(min)..(max)|NaN]``."""
    numeric = F.col("kind").isin("int", "float")
    # a whole-number column with missing values is a column of floats
    kind = F.when((F.col("kind") == "int") & has_nan, F.lit("float")).otherwise(F.col("kind"))

    def shown(bound: str) -> Column:
        whole = F.col(bound).cast("bigint").cast("string")
        flag = F.when(F.col(bound) == 1, "True").otherwise("False")
        text = (
            F.when(F.col("kind") == "bool", F.when(F.col(bound).isNotNull(), flag))
            .when((F.col("kind") == "int") & ~has_nan, whole)
            .when(numeric, number_text(F.col(bound)))
        )
        return F.coalesce(text, F.lit("NaN"))

    tail = F.when(has_nan, F.lit("|NaN]")).otherwise(F.lit("]"))
    body = F.when(F.col("kind") == "str", F.lit("str[..")).otherwise(
        F.concat(kind, F.lit("[("), shown("low"), F.lit(")..("), shown("high"), F.lit(")"))
    )
    text = F.when(F.col("n_rows") == 0, F.lit("NaN")).otherwise(F.concat(body, tail))
    return stats.select(
        "column",
        kind.alias("type"),
        F.col("low").alias("min"),
        F.col("high").alias("max"),
        has_nan.alias("has_nan"),
        text.alias("description"),
    )


def profile(df: DataFrame) -> DataFrame:
    """(column, type, min, max, has_nan, description) per column, from one pass."""
    stats = df.agg(F.array(*_statistics(df, df.columns)).alias("s"))
    stats = stats.select(F.explode("s").alias("s")).select("s.*")
    return _describe(stats, F.col("n_present") < F.col("n_rows"))


def profile_outer_join(tables: Sequence[DataFrame], index: str) -> DataFrame:
    """The profile of the outer join of tables, without joining them.

    Each table is summarised on its own; a table that lacks index values another
    one holds gets missing values in all its columns.
    """
    check_same_index(tables, index)
    presence = index_presence(tables, index)
    in_table = [F.count_if(is_present(i)) for i in range(len(tables))]
    # one row per table: does it lack index values another one holds?
    partial = (
        presence.agg(F.count(F.lit(1)).alias("n_keys"), F.array(*in_table).alias("held"))
        .select("n_keys", F.posexplode("held").alias("t", "n_held"))
        .select("t", (F.col("n_held") < F.col("n_keys")).alias("partial"))
    )
    parts = []
    for i, table in enumerate(tables):
        columns = [c for c in table.columns if c != index]
        stats = table.agg(F.array(*_statistics(table, columns)).alias("s"))
        parts.append(stats.select(F.explode("s").alias("s")).select("s.*", F.lit(i).alias("t")))
        own = table.agg(F.array(*_statistics(table, [index])).alias("s"))
        parts.append(own.select(F.explode("s").alias("s")).select("s.*", F.lit(-1).alias("t")))
    stats = parts[0]
    for part in parts[1:]:
        stats = stats.unionByName(part)
    # the index of the join spans the indices of all tables
    merged = stats.groupBy("column", "kind", "t").agg(
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("n_present").alias("n_present"),
        F.sum("n_rows").alias("n_rows"),
    )
    merged = merged.join(partial, "t", "left")
    lacking = F.coalesce("partial", F.lit(False))
    return _describe(merged, (F.col("n_present") < F.col("n_rows")) | lacking)


def shape(df: DataFrame, index: Sequence[str]) -> DataFrame:
    """(n_rows, n_columns) of a table, the index not counted."""
    width = len([c for c in df.columns if c not in index])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(width).cast("bigint")
    )
