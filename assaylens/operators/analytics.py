"""Analyses of long measurements (accession, assay_name, sample_name, feature, value).

Statistics are aggregated per key, combined before the shuffle, and joined back.
Unlike a window over the key, this neither sorts nor gathers a sample or a
feature that holds most of the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.operators.ranking import join_back, with_position

SAMPLE = ("accession", "assay_name", "sample_name")


def normalise(df: DataFrame, sample: Sequence[str] = SAMPLE) -> DataFrame:
    """Divide each value by the mean of its sample; a mean of zero gives NULL."""
    means = df.groupBy(*sample).agg(F.avg("value").alias("_mean"))
    joined = join_back(df, means, sample)
    return joined.withColumn("value", F.try_divide("value", "_mean")).drop("_mean")


def log_value(df: DataFrame, pseudo_count: float, base: int | None = None) -> DataFrame:
    """Natural or base-10 logarithm of value plus pseudo-count."""
    shifted = F.col("value") + F.lit(pseudo_count)
    logged = {None: F.log, 10: F.log10}[base](shifted)
    return df.withColumn("value", F.when(shifted > 0, logged))


def z_score(df: DataFrame, feature: Sequence[str] = ("feature",)) -> DataFrame:
    """Centre and scale the values of each feature by its sample deviation."""
    stats = df.groupBy(*feature).agg(
        F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std")
    )
    scaled = F.try_divide(F.col("value") - F.col("_mean"), F.col("_std"))
    return join_back(df, stats, feature).withColumn("value", scaled).drop("_mean", "_std")


def complete_features(df: DataFrame, n_samples: int | DataFrame, feature: str = "feature") -> DataFrame:
    """Keep the features that have a value in every sample.

    ``n_samples`` is the number of samples, or a one-row frame that holds it.
    """
    counts = df.filter(F.col("value").isNotNull()).groupBy(feature).agg(F.count("value").alias("_n"))
    if isinstance(n_samples, int):
        full = counts.filter(F.col("_n") == n_samples)
    else:
        full = counts.filter(F.col("_n") == n_samples.select(n_samples.columns[0]).scalar())
    return df.join(full, feature, "left_semi")


def complete_rows(df: DataFrame, index: str) -> DataFrame:
    """Rows of a wide table without any missing value."""
    return df.dropna("any", subset=[c for c in df.columns if c != index])


def filled_rows(df: DataFrame, index: str, value: float = 0.0) -> DataFrame:
    """A wide table with missing values replaced."""
    return df.fillna(value, subset=[c for c in df.columns if c != index])


def rounded(df: DataFrame, index: str) -> DataFrame:
    """A wide table of whole numbers; halves go to the even neighbour, as in R."""
    return df.select(
        F.col(f"`{index}`"),
        *[F.rint(f"`{c}`").alias(c) for c in df.columns if c != index],
    )


def most_variable(df: DataFrame, k: int = 50, feature: str = "feature") -> DataFrame:
    """The k features of the largest sample deviation (ties by name)."""
    spread = df.groupBy(feature).agg(F.stddev_samp("value").alias("std"))
    known = spread.filter(F.col("std").isNotNull())
    return known.orderBy(F.col("std").desc(), F.col(feature).asc()).limit(k)


def keep_features(df: DataFrame, features: DataFrame, feature: str = "feature") -> DataFrame:
    """The measurements of the listed features."""
    return df.join(features.select(feature), feature, "left_semi")


def significance(
    df: DataFrame,
    p_value: str = "padj",
    fold_change: str = "log2FoldChange",
    p_below: float = 0.05,
    change_above: float = 2.0,
) -> DataFrame:
    """Add ``neg_log10_p`` and the flag ``significant``."""
    p = F.coalesce(F.col(p_value), F.lit(1.0))
    logged = -F.log10(F.when(p > 0, p))  # a p value of zero has no finite logarithm
    flag = (F.col(p_value) < p_below) & (F.abs(F.col(fold_change)) > change_above)
    return df.withColumn("neg_log10_p", logged).withColumn(
        "significant", F.coalesce(flag, F.lit(False))
    )


def significant_rows(df: DataFrame, fold_change: str = "log2FoldChange") -> DataFrame:
    """The significant rows by fold change, without the helper columns."""
    kept = df.filter("significant").drop("significant", "neg_log10_p")
    return kept.orderBy(F.col(fold_change).asc_nulls_last())


def magnitude(value: str = "value") -> Column:
    """The largest absolute value of a column, as an aggregate."""
    return F.max(F.abs(value))


def largest_magnitude(df: DataFrame) -> DataFrame:
    """One row: the largest absolute value of all measurements."""
    return df.agg(magnitude().alias("vmax"))


def recode(value: Column, mapping: Mapping[str, str]) -> Column:
    """Replace listed values; others become NULL."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def factor_level(value: Column) -> Column:
    """Factor value with dots for spaces."""
    return F.replace(value, F.lit(" "), F.lit("."))


def batch_label(accession: Column) -> Column:
    """Batch name of an accession, with underscores for hyphens."""
    return F.replace(accession, F.lit("-"), F.lit("_"))


def make_unique(df: DataFrame, name: str, order: Sequence[str], alias: str = "unique_name") -> DataFrame:
    """Number repeated names as ``x, x.1, x.2`` in the given order.

    Numbers whose result is itself among the names are passed over. Of the merged
    sequence "duplicates and taken numbers" the position is the number to use, so
    no name, however frequent, is processed in one task.
    """
    ordered = with_position(df, [F.col(c) for c in order], [name], "_copy")
    # x.k among the names: k is taken for x
    pattern = r"^(.*)\.([1-9][0-9]{0,17})$"
    taken = (
        df.filter(F.col(name).rlike(pattern))
        .select(
            F.regexp_extract(name, pattern, 1).alias(name),
            F.regexp_extract(name, pattern, 2).cast("bigint").alias("_k"),
        )
        .distinct()
    )
    repeated = df.groupBy(name).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    taken = taken.join(repeated.select(name), name, "left_semi")
    if taken.isEmpty():
        number = F.col("_copy")
        return ordered.withColumn(alias, _suffixed(name, number)).drop("_copy")
    # the i-th taken number k moves every duplicate from the (k - i)-th on by one
    taken = with_position(taken, [F.col("_k")], [name], "_i")
    marks = taken.select(name, (F.col("_k") - F.col("_i")).alias("_at"), F.lit(0).alias("_dup"))
    dups = ordered.filter("_copy > 0").select(
        name, F.col("_copy").alias("_at"), F.lit(1).alias("_dup")
    )
    merged = with_position(
        marks.unionByName(dups), [F.col("_at"), F.col("_dup")], [name], "_before"
    )
    numbers = merged.filter("_dup = 1").select(
        name, F.col("_at").alias("_copy"), (F.col("_before") + 1).alias("_number")
    )
    out = join_back(ordered, numbers, [name, "_copy"], "left")
    number = F.coalesce("_number", "_copy")
    return out.withColumn(alias, _suffixed(name, number)).drop("_copy", "_number")


def _suffixed(name: str, number: Column) -> Column:
    return F.when(F.col("_copy") == 0, F.col(name)).otherwise(
        F.concat(F.col(name), F.lit("."), number.cast("string"))
    )


def design_matrix(measurements: DataFrame, annotation: DataFrame, factors: Mapping[str, Column]) -> DataFrame:
    """One row per measured sample: its flat name, its batch and the factors."""
    measured = measurements.select(*SAMPLE).distinct()
    rows = join_back(measured, annotation, SAMPLE, "left")
    return rows.select(
        F.concat_ws("/", *SAMPLE).alias("name"),
        batch_label(F.col("accession")).alias("batch"),
        *[c.alias(n) for n, c in factors.items()],
    )
