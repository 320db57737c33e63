"""Sample and assay views of the annotation, and what values it holds."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.operators.lists import listed_values
from assaylens.operators.order import natural_order, sort_by_id
from assaylens.operators.predicates import (
    ANNOTATION,
    FIELDS,
    IdSelection,
    Predicate,
    filter_samples,
)

CATEGORY_ORDER = ("id", "investigation", "study", "assay", "file")
IDS = {
    "id.accession": "accession",
    "id.assay name": "assay_name",
    "id.sample name": "sample_name",
    "id.study name": "study_name",
}


def reduce_paths(paths: Iterable[str]) -> list[str]:
    """Drop the paths that extend another one; sort the rest."""
    unique = sorted(set(paths))
    return [p for p in unique if not any(p.startswith(f"{q}.") for q in unique)]


def ordered_paths(paths: Iterable[str]) -> list[str]:
    """Ids first, then category by category, by name inside each."""

    def rank(path: str) -> tuple[int, str]:
        category = path.split(".")[0]
        known = category in CATEGORY_ORDER
        return (CATEGORY_ORDER.index(category) if known else len(CATEGORY_ORDER), path)

    return sorted(paths, key=rank)


def header_levels(path: str) -> tuple[str, str]:
    """The two header levels of an annotation column; a missing level is ``*``.

    Annotation is headed by its block (category and field), anything else by its category.
    """
    category, _, field = path.partition(".")
    if category not in ANNOTATION:
        return category or "*", field or "*"
    block, _, name = field.partition(".")
    return f"{category}.{block}" if block else category, name or "*"


def named_paths(predicates: Iterable[Predicate | IdSelection], fields: Iterable[str]) -> list[str]:
    """The annotation paths a query asks for."""
    paths = [p for item in predicates for p in item.paths] + list(fields)
    return reduce_paths(p for p in paths if not p.startswith("id."))


def project(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Keep only the annotation at or below the paths."""
    return df.withColumn("attrs", F.map_filter("attrs", lambda k, _: _below(k, paths)))


def _below(key: Column, paths: Sequence[str]) -> Column:
    tests = [(key == p) | key.startswith(f"{p}.") for p in paths]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def expand_paths(df: DataFrame, paths: Sequence[str]) -> list[str]:
    """The single fields below the paths: blocks are looked up in the data.

    The result becomes a schema, as wide as the annotation has fields. To keep any
    number of fields as rows, take ``facet_values``.
    """
    blocks = [p for p in paths if p.split(".")[0] in ANNOTATION and p.count(".") < 2]
    single = [p for p in paths if p not in blocks and not p.startswith("file")]
    if blocks:
        keys = df.select(F.explode(F.map_keys("attrs")).alias("k")).filter(
            _below(F.col("k"), blocks)
        )
        single += [r["k"] for r in keys.distinct().collect()]
    return ordered_paths(set(single))


def samples_view(
    df: DataFrame,
    *predicates: Predicate | IdSelection,
    fields: Iterable[str] = (),
    sort: bool = True,
) -> DataFrame:
    """One row per sample: its ids and the asked-for annotation, in natural id order.

    Fields are read out of the map in place; nothing is shuffled but for the sort.
    """
    paths = named_paths(predicates, fields)
    found = filter_samples(df, predicates)
    columns = [F.col(c).alias(name) for name, c in IDS.items() if c in found.columns]
    columns += [F.col("attrs").getItem(p).alias(p) for p in expand_paths(found, paths)]
    if "file" in found.columns:
        columns += [
            F.col("file").getField(f).alias(f"file.{f}") for f in sorted(FIELDS["file"])
        ]
    table = found.select(*columns)
    if not sort:
        return table
    return table.orderBy(*natural_order([n for n in IDS if n in table.columns]))


def assays_view(
    df: DataFrame,
    *predicates: Predicate | IdSelection,
    fields: Iterable[str] = (),
    sort: bool = True,
) -> DataFrame:
    """One row per assay: does any of its samples have the field?"""
    paths = named_paths(predicates, fields)
    found = filter_samples(df, predicates)
    flags = [
        F.coalesce(F.bool_or(F.col("attrs").getItem(p).isNotNull()), F.lit(False)).alias(p)
        for p in expand_paths(found, paths)
    ]
    keys = ["accession", "assay_name"]
    if flags:
        table = found.groupBy(*keys).agg(*flags)
    else:
        table = found.select(*keys).distinct()
    return sort_by_id(table, keys) if sort else table


def facet_values(df: DataFrame) -> DataFrame:
    """(category, subfield, key, value): every distinct annotation value.

    Only the fields that can be queried are listed, and no comments. Equal values
    are combined before the shuffle.
    """
    allowed = reduce(
        lambda a, b: a | b,
        [
            (F.col("category") == c) & F.col("subfield").isin(*sorted(FIELDS[c]))
            for c in ANNOTATION
        ],
    )
    entries = df.select(F.explode("attrs").alias("path", "value"))
    parts = F.split("path", r"\.", 3)
    return (
        entries.select(
            F.get(parts, F.lit(0)).alias("category"),
            F.get(parts, F.lit(1)).alias("subfield"),
            F.get(parts, F.lit(2)).alias("key"),
            "value",
        )
        .filter(allowed & F.col("key").isNotNull() & (F.col("key") != "comment"))
        .distinct()
    )


def facet_lists(df: DataFrame) -> DataFrame:
    """The distinct values of each field in order, one row each, with their number."""
    return listed_values(facet_values(df), ["category", "subfield", "key"], "value", "value")


def facet_keys(df: DataFrame) -> DataFrame:
    """(category, subfield, key): the fields that occur."""
    return _paths(df).select("category", "subfield", "key").distinct()


def facet_blocks(df: DataFrame) -> DataFrame:
    """(category, subfield): the blocks that occur."""
    return _paths(df).select("category", "subfield").distinct()


def _paths(df: DataFrame) -> DataFrame:
    keys = df.select(F.map_from_arrays(F.map_keys("attrs"), F.map_keys("attrs")).alias("attrs"))
    return facet_values(keys)


def assays_by_accession(df: DataFrame) -> DataFrame:
    """(accession, assay_name) pairs in natural order."""
    return sort_by_id(df.select("accession", "assay_name").distinct())


def datatypes(df: DataFrame) -> DataFrame:
    """The distinct datatypes over all files of all samples."""
    kinds = df.select(F.explode("files").alias("f")).select(F.col("f.datatype").alias("datatype"))
    return kinds.filter(F.col("datatype").isNotNull()).distinct()


def carried_sets(descriptors: DataFrame) -> DataFrame:
    """(kind, value): accessions, datatypes and GCT flags that come with a result."""
    entries = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"))
            for k, c in (
                ("accession", "accession"),
                ("datatype", "datatype"),
                ("gct_valid", "gct_valid"),
            )
        ]
    )
    rows = descriptors.select(F.explode(entries).alias("e")).select("e.kind", "e.value")
    return rows.distinct()


def samples_per_accession(df: DataFrame) -> DataFrame:
    """Number of samples of each accession."""
    return df.groupBy("accession").agg(F.count("sample_name").alias("n_samples"))
