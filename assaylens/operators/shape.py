"""From parsed tab rows to sample rows with a map of annotation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.errors import guarded, raise_if_any
from assaylens.functions.text import LIST_SEPARATOR, harmonised_key, is_empty
from assaylens.operators.names import best_match
from assaylens.operators.ranking import few, join_back

LEGACY = "study.material type"
MATERIAL = "study.characteristics.material type"


def key_collisions(keys: DataFrame, group: Sequence[str]) -> DataFrame:
    """Different keys of one group that become equal once harmonised."""
    return (
        keys.select(*group, "key", harmonised_key(F.col("key")).alias("harmonised"))
        .groupBy(*group, "harmonised")
        .agg(F.min("key").alias("key"), F.max("key").alias("other"))
        .filter(F.col("key") != F.col("other"))
    )


def harmonise_long(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Harmonise the column ``key`` of long rows; colliding keys are an error."""
    raise_if_any(key_collisions(df, group), "two fields of a tab become one key; rename one of them")
    return df.withColumn("key", harmonised_key(F.col("key")))


def drop_empty(attrs: Column) -> Column:
    """Drop the entries of a map whose value is missing or empty text."""
    return F.map_filter(attrs, lambda _, v: ~is_empty(v))


def leaf_elements(attrs: Column) -> Column:
    """All distinct items of the values, which may be comma-separated lists."""
    items = F.transform(F.map_values(attrs), lambda v: F.split(v, LIST_SEPARATOR))
    return F.array_distinct(F.flatten(items))


def nested_fields(attrs: Column) -> Column:
    """The entries below a field (``assay.parameter value.x``), without lists such as
    ``assay.raw data file``, whose items do not name files of the dataset."""
    return F.map_filter(attrs, lambda k, _: F.size(F.split(k, r"\.")) > 2)


def move_material_type(attrs: Column) -> Column:
    """Move the legacy material type to the characteristics unless one is there.

    Entirely blank values are dropped at both places; a legacy text that lists
    several values is left where it is.
    """
    def filled(path: str) -> Column:
        value = attrs.getItem(path)
        return F.when(value.rlike(r"\S"), value)

    old, new = filled(LEGACY), filled(MATERIAL)
    single = F.when(F.size(F.split(old, LIST_SEPARATOR)) == 1, old)
    value = F.coalesce(new, single)
    rest = F.map_filter(
        attrs, lambda k, _: (k != MATERIAL) & ((k != LEGACY) | old.isNotNull())
    )
    moved = F.map_concat(rest, F.map_from_arrays(F.array(F.lit(MATERIAL)), F.array(value)))
    return F.when(value.isNotNull(), moved).otherwise(rest)


def bad_names(df: DataFrame, columns: Sequence[str] = ("accession", "assay_name")) -> DataFrame:
    """Rows whose names hold a character with a meaning in queries."""
    test = F.lit(False)
    for c in columns:
        test = test | F.coalesce(F.col(c).rlike("[$/]"), F.lit(False))
    return df.filter(test)


def assemble(
    assays: DataFrame,
    studies: DataFrame,
    study_assays: DataFrame,
    study_records: DataFrame,
    matched: DataFrame | None = None,
) -> DataFrame:
    """Sample rows from assay rows and the records they refer to.

    ``assays``: (accession, assay_name, sample_name, attrs); ``studies``: the same
    with study_name; ``study_assays`` and ``study_records``: (accession,
    assay_name / study_name, attrs). Study rows are found by best sample name
    match in the dataset; two equally good ones are an error, none leaves
    ``study_name`` NULL. Maps of the four sources are merged. If they have a
    ``document`` as well, ``documents`` holds the four, one by one; ``elements`` are those of
    all four. ``matched`` are the best matches, if they are known already.
    """
    nested = "document" in assays.columns
    listed = "elements" in assays.columns

    def also(prefix: str) -> list[Column]:
        kept = [c for c, there in (("document", nested), ("elements", listed)) if there]
        return [F.col(c).alias(f"{prefix}_{c}") for c in kept]

    if matched is None:
        names = assays.select("accession", F.col("sample_name").alias("name"))
        targets = studies.select("accession", F.col("sample_name").alias("candidate"))
        matched = best_match(names, targets, ["accession"])
    candidate = guarded(
        F.col("candidate"),
        F.col("n_matches") > 1,
        "an assay row fits several study rows",
        F.col("accession"),
        F.col("name"),
    )
    links = matched.filter(F.col("n_matches") > 0).select(
        "accession", F.col("name").alias("sample_name"), candidate.alias("candidate")
    )
    found = join_back(assays, links, ["accession", "sample_name"], "left")
    found = join_back(
        found.withColumnRenamed("candidate", "study_sample"),
        studies.select(
            "accession",
            F.col("sample_name").alias("study_sample"),
            "study_name",
            F.col("attrs").alias("_study"),
            *also("_study"),
        ),
        ["accession", "study_sample"],
        "left",
    )
    found = join_back(
        found,
        few(
            study_assays.select(
                "accession", "assay_name", F.col("attrs").alias("_assay_record"), *also("_assay_record")
            )
        ),
        ["accession", "assay_name"],
        "left",
    )
    found = join_back(
        found,
        few(
            study_records.select(
                "accession", "study_name", F.col("attrs").alias("_study_record"), *also("_study_record")
            )
        ),
        ["accession", "study_name"],
        "left",
    )
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    merged = F.map_concat(
        *[
            F.coalesce(F.col(c), empty)
            for c in ("attrs", "_study", "_assay_record", "_study_record")
        ]
    )
    parts = {
        "assay": "document",
        "study": "_study_document",
        "assay_record": "_assay_record_document",
        "study_record": "_study_record_document",
    }
    documents = [F.struct(*[F.col(c).alias(n) for n, c in parts.items()]).alias("documents")] if nested else []
    own = ("elements", "_study_elements", "_assay_record_elements", "_study_record_elements")
    none = F.array().cast("array<string>")
    elements = [F.array_distinct(F.concat(*[F.coalesce(F.col(c), none) for c in own])).alias("elements")] if listed else []
    return found.select(
        "accession",
        "assay_name",
        "sample_name",
        "study_name",
        "study_sample",
        merged.alias("attrs"),
        *documents,
        *elements,
    )


def missing_studies(samples: DataFrame) -> DataFrame:
    """Warnings: samples without a study entry."""
    return samples.filter(F.col("study_name").isNull()).select(
        "accession", "assay_name", "sample_name", F.lit("no study row for this sample").alias("warning")
    )
