"""Files and the samples they belong to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.operators.documents import listed_items
from assaylens.operators.lists import listed_values
from assaylens.operators.ranking import few, join_back

MOST_RULES = 50_000  # files of short names that every task may get

TECHNOLOGY = "investigation.study assays.study assay technology type"

# Technology types (lower case) behind each condition on a file.
TECHNOLOGIES = {
    "microarray": ("microarray", "dna microarray"),
    "rna-seq": ("rna sequencing (rna-seq)",),
}


def technology(df_attrs: Column | None = None) -> Column:
    """The technology type of a sample."""
    attrs = F.col("attrs") if df_attrs is None else df_attrs
    return attrs.getItem(TECHNOLOGY)


def condition_holds(condition: Column, tech: Column) -> Column:
    """A file without a condition always applies; else the technology decides."""
    lowered = F.lower(F.coalesce(tech, F.lit("")))
    test = F.lit(False)
    for name, types in TECHNOLOGIES.items():
        test = test | ((condition == name) & lowered.isin(*types))
    return condition.isNull() | test


def attach_files(samples: DataFrame, files: DataFrame) -> DataFrame:
    """(accession, assay_name, sample_name, filename): the files of each sample.

    A file belongs to a sample when its name is among the sample's annotation
    values (column ``elements``, or else the texts of its ``document``), or when it is
    internal to the dataset; the technology condition of the file must hold in either
    case. Both cases are equality joins. The files are worked out once; unless they are very
    many, no sample is shuffled before it has met them, so that neither a dataset with most of the
    samples nor a text that most of them have lands in one task. The repeats of those that name a
    file are then removed by sample.
    """
    ids = ["accession", "assay_name", "sample_name"]
    source = "elements" if "elements" in samples.columns else "document"
    with_tech = samples.select(*ids, technology().alias("_tech"), source)
    if source == "elements":
        items = with_tech.select(*ids, "_tech", F.explode("elements").alias("filename"))
    else:
        items = listed_items(with_tech, [*ids, "_tech"]).withColumnRenamed("item", "filename")
    rules = few(
        files.select("accession", "filename", "condition", F.coalesce("internal", F.lit(False)).alias("internal")),
        MOST_RULES,
    )
    listed = rules.filter(~F.col("internal"))
    naming = items.join(listed, ["accession", "filename"], "left_semi")
    # by sample first: a task then holds the names of its own samples only
    named = naming.repartition(*ids).distinct().join(listed, ["accession", "filename"], "inner")
    internal = with_tech.drop(source).join(
        rules.filter(F.col("internal")), "accession", "inner"
    )
    columns = [*ids, "_tech", "filename", "condition"]
    both = named.select(*columns).unionByName(internal.select(*columns))
    return both.filter(condition_holds(F.col("condition"), F.col("_tech"))).select(
        *ids, "filename"
    )


def file_descriptors(unnested: DataFrame) -> DataFrame:
    """Files with the samples they cover, one row per file of an assay and sample.

    ``unnested`` holds one row per sample and file, as ``filter_samples`` returns it
    for a predicate on files. ``position`` numbers the samples of a file in order,
    ``n_values`` counts them.
    """
    flat = unnested.select(
        "accession",
        "assay_name",
        technology().alias("technology"),
        F.col("file.filename").alias("filename"),
        F.col("file.datatype").alias("datatype"),
        "sample_name",
    )
    keys = ["accession", "assay_name", "technology", "filename", "datatype"]
    return listed_values(flat, keys, "sample_name", "sample_name", distinct=False)


def samples_of_file(samples: DataFrame, accession: str, assay: str, filename: str) -> DataFrame:
    """The samples one file covers."""
    chosen = samples.filter((F.col("accession") == accession) & (F.col("assay_name") == assay))
    return (
        chosen.filter(F.exists("files", lambda f: f.getField("filename") == filename))
        .select("sample_name")
        .distinct()
    )


def files_with_samples(samples: DataFrame) -> DataFrame:
    """(accession, assay_name, filename, sample_name): the reverse lookup for all files."""
    return (
        samples.select(
            "accession", "assay_name", F.explode("files").alias("f"), "sample_name"
        )
        .select("accession", "assay_name", F.col("f.filename").alias("filename"), "sample_name")
        .distinct()
    )


def select_measurements(
    measurements: DataFrame, samples: DataFrame, keys: Sequence[str] = ("accession", "assay_name", "sample_name")
) -> DataFrame:
    """Keep the measurements of the given samples only."""
    wanted = samples.select(*keys).distinct()
    return measurements.join(wanted, list(keys), "left_semi")


def align(rows: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per id, as in a reindex: ids without a row get NULLs, others drop out."""
    wanted = ids.select(*keys).distinct()
    return join_back(wanted, rows, list(keys), "left")
