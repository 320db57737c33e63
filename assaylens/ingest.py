"""From archives of annotation tabs and file listings to sample rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylens.errors import guarded, raise_if_any
from assaylens.functions.text import braces
from assaylens.operators import documents
from assaylens.operators import files as file_ops
from assaylens.operators import shape
from assaylens.operators.names import ambiguous, best_match
from assaylens.operators.ranking import few, join_back
from assaylens.session import shared_folder
from assaylens.sources import archives as archives_source
from assaylens.sources import isa

IDS = ["accession", "assay_name", "sample_name"]


def wrong_archive_counts(files: DataFrame) -> DataFrame:
    """Datasets that do not list exactly one archive of annotation tabs."""
    count = F.count_if(F.col("datatype") == "isa").alias("n_archives")
    return files.groupBy("accession").agg(count).filter("n_archives <> 1")


def _entities(records: DataFrame, section: str, name: str) -> DataFrame:
    """(accession, name, attrs, document) of the studies or assays of an investigation."""
    found = isa.entity_records(records, section)
    entity = guarded(
        F.col("entity"), F.col("entity").isNull(), f"records of {section} without a name", F.col("accession")
    )
    return found.select(
        "accession",
        entity.alias(name),
        isa.record_attrs(F.col("content"), section).alias("attrs"),
        "document",
        "elements",
    )


def _reasons(found: list[tuple[DataFrame, str]]) -> DataFrame:
    """(accession, reason) of all offending rows."""
    rows = [df.select("accession", F.lit(reason).alias("reason")) for df, reason in found]
    return reduce(DataFrame.unionByName, rows).distinct()


def header_failures(archives: DataFrame, lines: DataFrame, files: DataFrame) -> DataFrame:
    """(accession, reason): datasets whose tabs cannot be interpreted."""
    parsed = isa.parsed_headers(isa.tab_headers(lines))
    records = isa.investigation_records(isa.investigation_cells(lines))
    listed = files.join(archives.select("accession").distinct(), "accession", "left_semi")
    tabs = lines.filter(F.col("line_no") == 0).withColumnRenamed("tab", "assay_name")
    broken = isa.broken_archives(lines)
    whole = archives.join(broken, "accession", "left_anti")
    found = _reasons(
        [
            (isa.missing_tabs(whole, lines), "missing tab"),
            (isa.unnamed_tabs(lines, parsed), "a tab has no Sample Name column"),
            (wrong_archive_counts(listed), "not exactly one archive listed"),
            (isa.early_qualifiers(parsed), "a tab begins with a column that describes another column"),
            (isa.duplicate_fields(parsed), "two columns of a tab have the same field and subfield"),
            (isa.colliding_fields(parsed), "two fields of a tab become one key; rename one of them"),
            (isa.wrong_record_counts(records), "more than one investigation record"),
            (isa.unnamed_entities(records, "Study"), "study without a name"),
            (isa.unnamed_entities(records, "Study Assays"), "assay without a name"),
            (shape.bad_names(tabs.filter("kind = 'a'")), "forbidden characters in a name"),
        ]
    )
    # of a broken archive nothing else can be said
    return found.join(broken, "accession", "left_anti").unionByName(broken).distinct()


def study_matches(rows: DataFrame) -> DataFrame:
    """The study rows that the names of assay rows fit best (see ``names.best_match``)."""
    first = isa.first_names(rows)
    names = first.filter("kind = 'a'").select("accession", F.col("sample_name").alias("name"))
    targets = first.filter("kind = 's'").select("accession", F.col("sample_name").alias("candidate"))
    return best_match(names, targets, ["accession"])


def row_failures(rows: DataFrame, matched: DataFrame) -> DataFrame:
    """(accession, reason): datasets whose samples are ambiguous.

    ``rows`` hold ``sample_names``, as ``isa.with_names`` adds them; ``matched`` are their
    ``study_matches``.
    """
    return _reasons(
        [
            (isa.conflicting_names(rows), "a row names several samples"),
            (isa.duplicate_samples(isa.first_names(rows)), "a study lists a sample twice"),
            (ambiguous(matched), "an assay row fits several study rows"),
        ]
    )


def ingest(
    archives: DataFrame,
    files: DataFrame,
    formatter: Callable[[Column, Column], Column] = braces,
) -> tuple[DataFrame, DataFrame]:
    """Samples of all sound datasets, and (accession, reason) of the failed ones.

    ``archives``: (accession, content), one ZIP archive each. ``files``: the latest
    files, typed (accession, filename, datatype, internal, condition, flags...).
    Samples are (ids, study_name, attrs, document, files): the flat annotation, all of it
    nested, and the files it names. A dataset that breaks a rule fails
    as a whole and leaves the others alone. What several steps read (unpacked
    lines, named rows, assembled samples) is checkpointed, so that archives are
    unpacked and rows are matched only once.
    """
    return _ingest(archives, isa.archive_lines(archives), files, formatter)


def ingest_folder(
    spark: SparkSession,
    path: str,
    files: DataFrame,
    formatter: Callable[[Column, Column], Column] = braces,
    range_bytes: int = archives_source.RANGE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """``ingest`` of the archives below a folder, each of them read by as many tasks as it needs."""
    lines = archives_source.scan_archives(spark, path, range_bytes)
    return _ingest(None, lines, files, formatter)


def _ingest(
    archives: DataFrame | None, lines: DataFrame, files: DataFrame, formatter: Callable[[Column, Column], Column]
) -> tuple[DataFrame, DataFrame]:
    """``ingest`` of unpacked lines; without ``archives`` they tell which there are."""
    shared_folder(lines.sparkSession)
    lines = lines.checkpoint()
    # the first lines of all tabs and the records: every tab and every broken archive is among them
    outline = lines.filter((F.col("line_no") == 0) | ~F.col("kind").isin("s", "a")).checkpoint()
    if archives is None:
        archives = outline.select("accession").distinct()
    unreadable = few(header_failures(archives, outline, files))
    lines, outline = (df.join(unreadable, "accession", "left_anti") for df in (lines, outline))

    layouts = isa.layouts(isa.tab_headers(outline))
    rows = isa.with_names(isa.tab_rows(lines), layouts).checkpoint()
    matched = study_matches(rows).checkpoint()
    unclear = few(row_failures(rows, matched))
    # an error raised in the plan could be evaluated before the failed datasets are left
    # out, so the names of the sound ones are read without a check
    rows = isa.first_names(rows.join(unclear, "accession", "left_anti"))
    rows = isa.with_row_elements(isa.with_row_documents(rows, layouts), layouts)
    rows = isa.annotate(rows, layouts, formatter)
    assays = rows.filter(F.col("kind") == "a").withColumnRenamed("tab", "assay_name")
    studies = rows.filter(F.col("kind") == "s").withColumnRenamed("tab", "study_name")

    cells = isa.investigation_cells(outline)
    records = isa.with_documents(isa.investigation_records(cells), cells).checkpoint()
    records = isa.with_elements(records).checkpoint()
    assembled = shape.assemble(
        assays.select(*IDS, "attrs", "document", "elements"),
        studies.select("accession", "study_name", "sample_name", "attrs", "document", "elements"),
        _entities(records, "Study Assays", "assay_name"),
        _entities(records, "Study", "study_name"),
        matched.join(unclear, "accession", "left_anti"),
    )
    whole = records.filter(F.col("section") == isa.SINGLE_RECORD)
    whole = whole.select(
        "accession",
        isa.record_attrs(F.col("content"), isa.SINGLE_RECORD).alias("_inv"),
        F.col("document").alias("_inv_document"),
        F.col("elements").alias("_inv_elements"),
    )
    described = join_back(assembled, few(whole), ["accession"], "left")
    # a column of its own, as it is read several times
    attrs = F.when(F.col("_inv").isNull(), F.col("attrs")).otherwise(F.map_concat("attrs", "_inv"))
    described = described.withColumn("attrs", attrs)
    none = F.array().cast("array<string>")
    document = documents.sample_document(
        F.col("documents.assay"),
        F.col("documents.study"),
        {
            "Study Assays": F.col("documents.assay_record"),
            "Study": F.col("documents.study_record"),
            isa.SINGLE_RECORD: F.col("_inv_document"),
        },
    )
    named = described.select(
        *IDS,
        "study_name",
        shape.move_material_type(F.col("attrs")).alias("attrs"),
        document.alias("document"),
        F.concat("elements", F.coalesce("_inv_elements", none)).alias("elements"),
    )
    return with_files(named.checkpoint(), files), unreadable.unionByName(unclear)


def build_samples(
    archives: DataFrame,
    files: DataFrame,
    formatter: Callable[[Column, Column], Column] = braces,
) -> DataFrame:
    """The samples of ``ingest``; any failed dataset is an error."""
    samples, failures = ingest(archives, files, formatter)
    raise_if_any(failures, "datasets cannot be read")
    return samples


def with_files(samples: DataFrame, files: DataFrame) -> DataFrame:
    """Sample rows with the array of their files: those they name, in comments as well, and
    the internal ones.

    Both are few per sample: an annotation names a handful of files, and a dataset
    has one archive and a few tables that are internal. The items of the texts of documents
    are read from the column ``elements``, if there is one.
    """
    if not {"document", "elements"} & set(samples.columns):
        elements = shape.leaf_elements(shape.nested_fields(F.col("attrs")))
        samples = samples.withColumn("elements", elements)
    # by sample first: the lists of files need no further shuffle
    links = file_ops.attach_files(samples, files).repartition(*IDS).distinct()
    samples = samples.drop("elements")
    shown = [c for c in files.columns if c not in ("accession", "condition", "ts", "version")]
    told = few(files.select("accession", *shown), file_ops.MOST_RULES)
    described = join_back(links, told, ["accession", "filename"])
    lists = described.groupBy(*IDS).agg(
        F.sort_array(F.collect_list(F.struct("filename", *[c for c in shown if c != "filename"]))).alias(
            "files"
        )
    )
    return join_back(samples, lists, IDS, "left")
