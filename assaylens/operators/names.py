"""Matching the names used in data files to sample names, in three tiers.

Tier 1: equal. Tier 2: equal once ``.``, ``_`` and ``-`` are all dots. Tier 3: one
dotted name begins with the other. Only the best tier that has a match counts.
Names meet only inside one group (accession and assay), always by equality of a
key: the third tier compares cut prefixes, never all pairs of names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.errors import guarded
from assaylens.functions.text import dotted
from assaylens.operators.order import natural_order
from assaylens.operators.ranking import join_back, with_position

EXACT, DOTTED, PREFIX = 1, 2, 3


def _prefixes(df: DataFrame, by: list[str], sizes: DataFrame) -> DataFrame:
    """Add ``probe``: each proper prefix of ``dotted`` whose length the other side has."""
    return (
        df.join(sizes, by)
        .withColumn("_size", F.explode("_sizes"))
        .filter(F.col("_size") < F.length("dotted"))
        .withColumn("probe", F.expr("substring(dotted, 1, _size)"))
        .drop("_size", "_sizes")
    )


def _sizes(df: DataFrame, by: list[str]) -> DataFrame:
    """Distinct name lengths per group: as many as the longest name has characters."""
    return df.groupBy(*by).agg(F.collect_set(F.length("dotted")).alias("_sizes"))


def _distinct_names(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Distinct names with their dotted form; a name or group that is NULL matches nothing."""
    named = df.select(*by, column).dropna().distinct()
    return named.withColumn("dotted", dotted(F.col(column)))


def _summary(theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Number and least of the candidates behind each key; combined before the shuffle."""
    return theirs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("candidate").alias("least")
    )


def best_match(names: DataFrame, candidates: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., name, tier, n_matches, candidate) for every distinct name.

    ``candidate`` is the match when there is exactly one, else NULL; ``tier`` is NULL
    without a match. Candidates are counted per key, so a short name that begins a
    million others costs one row, not a million. The first two tiers are joins on
    partitionings that the distinct names have already; only names without a match
    there are cut into prefixes.
    """
    by = list(by)
    ours = _distinct_names(names, by, "name")
    theirs = _distinct_names(candidates, by, "candidate")
    equal = theirs.select(*by, F.col("candidate").alias("name"), F.lit(True).alias("_equal"))
    alike = _summary(theirs, [*by, "dotted"])
    near = ours.join(equal, [*by, "name"], "left").join(alike, [*by, "dotted"], "left")
    decided = near.select(
        *by,
        "name",
        "dotted",
        F.when(F.col("_equal"), EXACT).when(F.col("n").isNotNull(), DOTTED).alias("tier"),
        F.when(F.col("_equal"), F.lit(1)).otherwise(F.col("n")).alias("n"),
        F.when(F.col("_equal"), F.col("name")).otherwise(F.col("least")).alias("least"),
    )
    rest = decided.filter(F.col("tier").isNull()).select(*by, "name", "dotted")
    rows = decided.filter(F.col("tier").isNotNull()).drop("dotted")
    return rows.unionByName(_prefix_summary(rest, theirs, alike, by)).select(
        *by,
        "name",
        "tier",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n_matches"),
        F.when(F.col("n") == 1, F.col("least")).alias("candidate"),
    )


def _prefix_summary(rest: DataFrame, theirs: DataFrame, alike: DataFrame, by: list[str]) -> DataFrame:
    """Third tier for the names that are left: counts from both directions."""
    cut = _summary(_prefixes(theirs, by, _sizes(rest, by)), [*by, "probe"])
    probes = (
        _prefixes(rest, by, _sizes(theirs, by))
        .withColumn("whole", F.lit(True))
        .unionByName(rest.withColumn("probe", F.col("dotted")).withColumn("whole", F.lit(False)))
    )
    keys = (
        alike.withColumnRenamed("dotted", "probe")
        .withColumn("whole", F.lit(True))
        .unionByName(cut.withColumn("whole", F.lit(False)))
    )
    return (
        probes.join(keys, [*by, "probe", "whole"], "left")
        .groupBy(*by, "name")
        .agg(F.sum("n").alias("n"), F.min("least").alias("least"))
        .withColumn("tier", F.when(F.col("n").isNotNull(), F.lit(PREFIX)))
    )


def all_matches(names: DataFrame, candidates: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., name, tier, candidate): every match in the best tier of each name."""
    by = list(by)
    ours = _distinct_names(names, by, "name")
    theirs = _distinct_names(candidates, by, "candidate")
    equal = theirs.select(*by, F.col("candidate").alias("name"), F.lit(True).alias("_equal"))
    alike = theirs.groupBy(*by, "dotted").agg(F.lit(True).alias("_alike"))
    near = ours.join(equal, [*by, "name"], "left").join(alike, [*by, "dotted"], "left")
    exact = near.filter("_equal").select(
        *by, "name", F.lit(EXACT).alias("tier"), F.col("name").alias("candidate")
    )
    similar = (
        near.filter("_equal IS NULL AND _alike")
        .select(*by, "name", "dotted")
        .join(theirs, [*by, "dotted"])
        .select(*by, "name", F.lit(DOTTED).alias("tier"), "candidate")
    )
    rest = near.filter("_equal IS NULL AND _alike IS NULL").select(*by, "name", "dotted")
    whole = theirs.withColumnRenamed("dotted", "probe")
    cut = _prefixes(theirs, by, _sizes(rest, by)).drop("dotted")
    longer = _prefixes(rest, by, _sizes(theirs, by)).drop("dotted").join(whole, [*by, "probe"])
    shorter = rest.withColumnRenamed("dotted", "probe").join(cut, [*by, "probe"])
    far = longer.unionByName(shorter).select(*by, "name", F.lit(PREFIX).alias("tier"), "candidate")
    return exact.unionByName(similar).unionByName(far)


def ambiguous(matched: DataFrame) -> DataFrame:
    """Names with more than one match in their best tier."""
    return matched.filter(F.col("n_matches") > 1)


def match_columns(
    columns: DataFrame, samples: DataFrame, by: Sequence[str], keep_unmatched: bool | Column
) -> DataFrame:
    """(by..., name, harmonised, tier): the sample name each file column stands for.

    Columns with two or more matches are an error. Columns without a match keep
    their own name, or are left out, as ``keep_unmatched`` says.
    """
    matched = best_match(columns, samples, by)
    keep = F.lit(keep_unmatched) if isinstance(keep_unmatched, bool) else keep_unmatched
    harmonised = guarded(
        F.coalesce("candidate", "name"),
        F.col("n_matches") > 1,
        "a column name stands for several samples",
        F.col("name"),
    )
    return matched.filter((F.col("n_matches") > 0) | keep).select(
        *by, "name", harmonised.alias("harmonised"), "tier"
    )


def column_order(matched: DataFrame, original: DataFrame, by: Sequence[str]) -> DataFrame:
    """Order of the columns inside each file: (by..., name, harmonised, target).

    Matched columns take the places matched columns had, in natural order of their
    sample names; unmatched ones stay where they were. ``original`` holds
    (by..., name, place). A file with most of the columns is spread over many tasks.
    """
    by = list(by)
    joined = join_back(matched, original, [*by, "name"])
    joined = joined.withColumn("_m", F.col("tier").isNotNull())
    group = [*by, "_m"]
    slots = with_position(joined.select(*group, "place"), [F.col("place")], group, "_want")
    # unmatched columns keep their places, so their order is that of the places
    order = [F.when(~F.col("_m"), F.col("place")), *natural_order(["harmonised"])]
    wants = with_position(joined, order, group, "_want").select(*by, "name", "harmonised", "_m", "_want")
    return join_back(wants, slots, [*by, "_m", "_want"]).select(
        *by, "name", "harmonised", F.col("place").alias("target")
    )


def rename_samples(
    measurements: DataFrame, matched: DataFrame, by: Sequence[str], column: str = "sample_name"
) -> DataFrame:
    """Replace the file's names by sample names; rows of left-out columns drop out."""
    lookup = matched.select(*by, F.col("name").alias(column), "harmonised")
    return join_back(measurements, lookup, [*by, column]).select(
        *[F.col("harmonised").alias(column) if c == column else F.col(c) for c in measurements.columns]
    )
