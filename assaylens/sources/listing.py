"""File listings: schema, timestamps, versions, and file typing by name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylens.errors import guarded
from assaylens.functions.text import epoch_seconds, percent_encode
from assaylens.operators.ranking import join_back

LISTING_SCHEMA = (
    "accession string, file_name string, version string, remote_url string, "
    "date_created string, date_modified string"
)


@dataclass(frozen=True)
class Rule:
    """What a file name pattern says about a file."""

    pattern: str
    datatype: str
    type: str | None = None
    joinable: bool | None = None
    column_subset: str | None = None
    index_subset: str | None = None
    index_name: str | None = None
    gct_valid: bool | None = None
    internal: bool | None = None
    condition: str | None = None

    @property
    def cacheable(self) -> bool | None:
        return True if self.type == "table" else None


def _table(pattern: str, datatype: str, **flags: object) -> Rule:
    return Rule(pattern, datatype, type="table", **flags)  # type: ignore[arg-type]


_SAMPLES = "sample name"
_PCA = {"index_name": _SAMPLES, "index_subset": _SAMPLES, "internal": True}

# File name patterns and the datatypes and flags that go with them.
RULES = (
    Rule(r".*_metadata_.*\.zip$", "isa", internal=True),
    Rule(r"^GLDS-[0-9]+_.*annotReport\.txt$", "annotation report"),
    Rule(r"^GLDS-[0-9]+_.*_raw\.fastq(\.gz)?$", "raw reads"),
    Rule(r"^GLDS-[0-9]+_.*_trimmed\.fastq(\.gz)?$", "trimmed reads"),
    Rule(r"^GLDS-[0-9]+_.*\.bam$", "alignment"),
    Rule(r"^GLDS-[0-9]+_rna_seq(_all-samples)?_raw_multiqc_data\.zip$", "raw multiqc data"),
    Rule(r"^GLDS-[0-9]+_rna_seq(_all-samples)?_raw_multiqc_report\.htm(l)?$", "raw multiqc report"),
    Rule(r"^GLDS-[0-9]+_rna_seq(_all-samples)?_trimmed_multiqc_data\.zip$", "trimmed multiqc data"),
    Rule(
        r"^GLDS-[0-9]+_rna_seq(_all-samples)?_trimmed_multiqc_report\.htm(l)?$",
        "trimmed multiqc report",
    ),
    Rule(
        r"^GLDS-[0-9]+_array(_all-samples)?_normalized[_-]annotated\.rda$",
        "processed microarray data (rda)",
    ),
    _table(
        r"^GLDS-[0-9]+_array(_all-samples)?_normalized[_-]annotated\.txt$",
        "processed microarray data",
        column_subset=_SAMPLES,
        gct_valid=True,
    ),
    _table(
        r"^GLDS-[0-9]+_rna_seq(_all-samples)?_Normalized_Counts\.csv$",
        "normalized counts",
        column_subset=_SAMPLES,
        gct_valid=True,
    ),
    _table(
        r"^GLDS-[0-9]+_rna_seq(_all-samples)?_Unnormalized_Counts\.csv$",
        "unnormalized counts",
        joinable=True,
        column_subset=_SAMPLES,
        gct_valid=True,
    ),
    _table(
        r"^GLDS-[0-9]+_(array|rna_seq)(_all-samples)?_differential_expression\.csv$",
        "differential expression",
    ),
    Rule(
        r"^GLDS-[0-9]+_(array|rna_seq)(_all-samples)?_contrasts\.csv$",
        "differential expression contrasts",
    ),
    _table(
        r"^GLDS-[0-9]+_array(_all-samples)?_visualization_output_table\.csv$",
        "visualization table",
        internal=True,
        condition="microarray",
    ),
    _table(
        r"^GLDS-[0-9]+_rna_seq(_all-samples)?_visualization_output_table\.csv$",
        "visualization table",
        internal=True,
        condition="rna-seq",
    ),
    _table(
        r"^GLDS-[0-9]+_array(_all-samples)?_visualization_PCA_table\.csv$",
        "pca",
        condition="microarray",
        **_PCA,
    ),
    _table(
        r"^GLDS-[0-9]+_rna_seq(_all-samples)?_visualization_PCA_table\.csv$",
        "pca",
        condition="rna-seq",
        **_PCA,
    ),
)

TEXT_FLAGS = ("datatype", "type", "column_subset", "index_subset", "index_name", "condition")
BOOLEAN_FLAGS = ("cacheable", "joinable", "gct_valid", "internal")
FLAGS = (*TEXT_FLAGS, *BOOLEAN_FLAGS)


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """Listing rows of all datasets, from JSON lines."""
    return spark.read.schema(LISTING_SCHEMA).json(path)


def accessions(listing: DataFrame) -> DataFrame:
    """The datasets of a listing, with their number of files."""
    return listing.groupBy("accession").agg(F.count(F.lit(1)).alias("n_files"))


def with_timestamp(listing: DataFrame) -> DataFrame:
    """Add ``ts``: the later of creation and modification, -1 where neither is known."""
    created, modified = (
        epoch_seconds(F.col(c)) if c in listing.columns else F.lit(-1).cast("bigint")
        for c in ("date_created", "date_modified")
    )
    return listing.withColumn("ts", F.greatest(created, modified))


def latest_files(listing: DataFrame) -> DataFrame:
    """The latest row per (accession, filename); the higher version wins a tie."""
    keys = ("accession", "filename")
    rest = [c for c in listing.columns if c not in (*keys, "ts", "version")]
    newest = F.max(F.struct("ts", "version", *rest)).alias("_latest")
    return listing.groupBy(*keys).agg(newest).select(*keys, "_latest.*")


def _matched(filename: Column) -> Column:
    """Numbers of the rules that match; each pattern is a literal compiled once."""
    tests = [F.when(filename.rlike(r.pattern), i).otherwise(-1) for i, r in enumerate(RULES)]
    return F.array_remove(F.array(*tests), -1)


def conflicting_names(listing: DataFrame) -> DataFrame:
    """Files whose name matches more than one rule."""
    return listing.filter(F.size(_matched(F.col("filename"))) > 1).select("filename")


def rule_flags(spark: SparkSession) -> DataFrame:
    """(rule, flags...): the rules as a table of fixed size."""
    types = [f"{f} string" for f in TEXT_FLAGS] + [f"{f} boolean" for f in BOOLEAN_FLAGS]
    rows = [(i, *(getattr(r, f) for f in FLAGS)) for i, r in enumerate(RULES)]
    return spark.createDataFrame(rows, ", ".join(["_rule int", *types]))


def typed_files(listing: DataFrame) -> DataFrame:
    """Add datatype and flags by file name; names without a rule get NULLs.

    A name that matches more than one rule is an error.
    """
    matched = F.col("_matched")
    rule = guarded(
        F.get(matched, F.lit(0)),
        F.size(matched) > 1,
        "a file name fits several typing rules",
        F.col("filename"),
    )
    # never NULL: a test for NULL would be pushed below earlier aggregations, and
    # with it the matching of all the names they are about to reduce
    # versions share their name: each name is matched once
    names = listing.select("filename").distinct()
    numbered = names.withColumn("_matched", _matched(F.col("filename"))).select(
        "filename", F.coalesce(rule, F.lit(-1)).alias("_rule")
    )
    # one row per rule, whatever the size of the listing: always small enough to broadcast
    flags = F.broadcast(rule_flags(listing.sparkSession))
    described = numbered.join(flags, "_rule", "left").drop("_rule")
    return join_back(listing, described, ["filename"]).select(*listing.columns, *FLAGS)


def with_urls(
    listing: DataFrame, root: str, media_path: str, version: str = "version"
) -> DataFrame:
    """Add ``urls``: the media address and the remote address, both with the version."""
    query = F.concat(F.lit("?version="), F.col(version).cast("string"))
    quoted = [F.replace(percent_encode(F.col(c)), F.lit(" "), F.lit("%20")) for c in ("filename", "remote_url")]
    return listing.withColumn(
        "urls",
        F.array(
            F.concat(F.lit(root + media_path), quoted[0], query),
            F.concat(F.lit(root), quoted[1], query),
        ),
    )
