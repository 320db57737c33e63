"""The queries a user runs: samples, assays, data, and their output."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylens.errors import DataError, QueryError
from assaylens.operators import files as file_ops
from assaylens.operators import names, profile, tables, views
from assaylens.operators.order import natural_order
from assaylens.operators.predicates import Comparison, IdSelection, Predicate, filter_samples
from assaylens.sinks.formats import write_result
from assaylens.sources.catalogue import KEY, ROW, TableStore

SAMPLE = ["accession", "assay_name", "sample_name"]
FEW = 8  # tables that are joined one by one
SAMPLE_SUBSET = "sample name"  # the flag of files whose columns, or whose index, are samples


@dataclass(frozen=True)
class DataResult:
    """A data table with what is known about the files it came from."""

    table: DataFrame
    index: str
    datatypes: tuple[str, ...]
    gct_flags: tuple[bool | None, ...]
    subset: bool

    def profile(self) -> DataFrame:
        """Type, range and missing values of each column."""
        return profile.profile(self.table)

    def write(self, fmt: str, path: str) -> None:
        """Write the table as csv, tsv, json or gct."""
        write_result(
            self.table,
            "data",
            fmt,
            path,
            index=[self.index],
            datatypes=self.datatypes,
            gct_flags=self.gct_flags,
            subset=self.subset,
        )


@dataclass(frozen=True)
class Repository:
    """Annotation and measurements of many datasets.

    ``samples``: (accession, assay_name, sample_name, study_name, attrs MAP, files
    ARRAY<STRUCT<filename, datatype, flags...>>), one row per sample. Data are stored
    ``tables`` (see ``TableStore``), which come back whole, or numbers in long form as
    ``measurements``: (accession, assay_name, filename, feature, sample_name, value).
    Both hold sample names as the files spell them.
    """

    samples: DataFrame
    measurements: DataFrame | None = None
    tables: TableStore | None = None

    def samples_view(
        self, *predicates: Predicate | IdSelection, fields: Iterable[str] = (), sort: bool = True
    ) -> DataFrame:
        """Annotation of the samples that satisfy all predicates."""
        return views.samples_view(self.samples, *predicates, fields=fields, sort=sort)

    def assays_view(
        self, *predicates: Predicate | IdSelection, fields: Iterable[str] = (), sort: bool = True
    ) -> DataFrame:
        """Which assays have the fields of the query."""
        return views.assays_view(self.samples, *predicates, fields=fields, sort=sort)

    def facets(self) -> DataFrame:
        """(category, subfield, key, value) of all annotation."""
        return views.facet_values(self.samples)

    def descriptors(self, *predicates: Predicate | IdSelection) -> DataFrame:
        """One row per selected file of an assay, with its flags."""
        chosen = self._with_files(*predicates)
        flags = chosen.schema["file"].dataType.fieldNames()
        return chosen.select(
            "accession",
            "assay_name",
            file_ops.technology().alias("technology"),
            *[F.col(f"file.{f}").alias(f) for f in flags],
        ).distinct()

    def _with_files(self, *predicates: Predicate | IdSelection) -> DataFrame:
        if not any(isinstance(p, Predicate) and p.on_files for p in predicates):
            raise QueryError("a data query needs a file predicate (datatype or file name)")
        return filter_samples(self.samples, predicates)

    def long_data(self, *predicates: Predicate | IdSelection) -> DataFrame:
        """Measurements of the selected samples in the selected files, in long form.

        File column names become sample names by best match. In files whose columns
        are samples (``column_subset``) the samples that fail the predicates, and
        columns that stand for no sample, drop out; other files keep all columns. In
        files whose index is the sample (``index_subset``) the index is matched.
        """
        if self.measurements is None:
            raise QueryError("this repository has no measurements")
        chosen = self._with_files(*predicates)
        key = ["accession", "assay_name", "filename"]
        flags = chosen.schema["file"].dataType.fieldNames()
        by_column, by_index = (
            (F.coalesce(F.col(f"file.{f}") == SAMPLE_SUBSET, F.lit(False)) if f in flags else F.lit(False)).alias(n)
            for f, n in (("column_subset", "_by_column"), ("index_subset", "_by_index"))
        )
        files = chosen.select(
            "accession", "assay_name", F.col("file.filename").alias("filename"), by_column, by_index
        ).distinct()
        rows = self.measurements.join(files, key)
        name = F.when(F.col("_by_index"), F.col("feature")).otherwise(F.col("sample_name"))
        rows = rows.withColumn("_name", name)
        known = (
            file_ops.files_with_samples(self.samples)
            .join(files, key, "left_semi")
            .withColumnRenamed("sample_name", "candidate")
        )
        matched = names.match_columns(
            rows.select(*key, F.col("_name").alias("name")), known, key, keep_unmatched=True
        ).withColumnRenamed("name", "_name")
        selected = chosen.select(
            "accession", "assay_name", F.col("sample_name").alias("harmonised"), F.lit(True).alias("_selected")
        ).distinct()
        renamed = rows.join(matched, [*key, "_name"]).join(
            selected, ["accession", "assay_name", "harmonised"], "left"
        )
        kept = renamed.filter(~F.col("_by_column") | (F.col("tier").isNotNull() & F.col("_selected")))
        return kept.select(
            *key,
            F.when(F.col("_by_index"), F.col("harmonised")).otherwise(F.col("feature")).alias("feature"),
            F.when(F.col("_by_index"), F.col("sample_name")).otherwise(F.col("harmonised")).alias("sample_name"),
            "value",
        )

    def _stored(self, index: str | None, *predicates: Predicate | IdSelection) -> tuple[DataFrame, str]:
        """The selected stored tables as one, and the name of its index.

        Names are matched on the catalogue alone. Then every selected table is read once,
        with its selected columns; what reaches the driver are names of columns.
        """
        chosen = self._with_files(*predicates)
        flags = chosen.schema["file"].dataType.fieldNames()
        subset = {
            f: (F.coalesce(F.col(f"file.{f}") == SAMPLE_SUBSET, F.lit(False)) if f in flags else F.lit(False))
            for f in ("column_subset", "index_subset")
        }
        files = chosen.select(*KEY[:2], F.col("file.filename").alias("filename"), *[c.alias(f) for f, c in subset.items()])
        files = files.distinct()
        known = file_ops.files_with_samples(self.samples).join(files, list(KEY), "left_semi")
        known = known.withColumnRenamed("sample_name", "candidate")
        listed = self.tables.columns().join(files, list(KEY))
        headed = listed.filter("place > 0").select(*KEY, F.col("column").alias("name"), "place")
        matched = names.match_columns(headed, known, list(KEY), keep_unmatched=True)
        ordered = names.column_order(matched, headed, list(KEY))
        selected = chosen.select(*KEY[:2], F.col("sample_name").alias("harmonised"), F.lit(True).alias("selected"))
        wanted = (
            ordered.join(matched.select(*KEY, "name", F.col("tier").isNotNull().alias("found")), [*KEY, "name"])
            .join(selected.distinct(), [*KEY[:2], "harmonised"], "left")
            .join(files, list(KEY))
            .filter(~F.col("column_subset") | (F.col("found") & F.col("selected")))
            .orderBy(*KEY, "target")
            .collect()
        )
        first = {tuple(r[k] for k in KEY): r["column"] for r in listed.filter("place = 0").collect()}
        by_index = {tuple(r[k] for k in KEY) for r in files.filter("index_subset").collect()}
        if not first:
            raise DataError("the selected files are not stored; store them before asking for their data")
        index = index or next(iter(sorted(first.values())))
        of_file = defaultdict(list)
        for r in wanted:
            of_file[tuple(r[k] for k in KEY)].append(r)
        parts, owner = [], {}
        for key in sorted(first):
            columns = [F.col(f"`{first[key]}`").alias(index)]
            for r in of_file[key]:
                full = "/".join((*key[:2], r["harmonised"]))
                if full in owner:
                    raise DataError(f"{owner[full]} and {key[2]} both have the column {full}; select one file")
                owner[full] = key[2]
                columns.append(F.col(f"`{r['name']}`").alias(full))
            part = self.tables.read(*key).select(*columns, ROW)
            parts.append(self._matched_index(part, index, known, key) if key in by_index else part)
        if len(parts) == 1:
            return parts[0], index
        # a plan of a few joins reads single columns; one of hundreds takes longer to make than to run
        join = tables.outer_join if len(parts) <= FEW else tables.outer_join_many
        return join([part.drop(ROW) for part in parts], index), index

    @staticmethod
    def _matched_index(part: DataFrame, index: str, known: DataFrame, key: tuple[str, ...]) -> DataFrame:
        """A table whose index holds sample names, with the names the annotation uses."""
        own = known.filter(reduce(lambda a, b: a & b, [F.col(k) == v for k, v in zip(KEY, key)]))
        spelled = part.select(*[F.lit(v).alias(k) for k, v in zip(KEY, key)], F.col(f"`{index}`").alias("name"))
        found = names.match_columns(spelled, own, list(KEY), keep_unmatched=True)
        lookup = found.select(F.col("name").alias("_spelled"), F.col("harmonised").alias("_harmonised"))
        joined = part.join(lookup, F.col(f"`{index}`") == F.col("_spelled"), "left")
        renamed = F.coalesce("_harmonised", F.col(f"`{index}`"))
        return joined.select(*[renamed.alias(c) if c == index else F.col(f"`{c}`") for c in part.columns])

    def data(
        self,
        *predicates: Predicate | IdSelection,
        columns: Sequence[str] = (),
        comparisons: Iterable[Comparison] = (),
        limit: int | None = None,
        offset: int = 0,
    ) -> DataResult:
        """Wide table of the selected samples: feature × ``accession/assay/sample``.

        Files of several datasets are joined on the feature; comparisons apply to
        the joined table and may use columns that are not selected. A single stored
        table keeps its rows in their order; joined ones are in natural order of the index.
        """
        descriptors = self.descriptors(*predicates)
        flags = descriptors.columns
        for flag in ("joinable", "type", "index_name", "gct_valid"):
            if flag not in flags:
                descriptors = descriptors.withColumn(flag, F.lit(None).cast("string"))
        tables.check_joinable(descriptors)
        kinds = descriptors.select(
            "datatype", "type", F.col("gct_valid").cast("boolean").alias("gct"), "index_name"
        ).distinct().collect()  # at most one row per typing rule
        if not kinds:
            raise DataError("no file fits the filters")
        if any(k["type"] != "table" for k in kinds):
            raise DataError("only tables can be read as data; select a table file")
        index = next((k["index_name"] for k in kinds if k["index_name"]), None)
        if self.tables is not None:
            wide, index = self._stored(index, *predicates)
        else:
            index = index or "feature"
            long = self.long_data(*predicates).select(
                F.col("feature").alias(index), F.concat_ws("/", *SAMPLE).alias("column"), "value"
            )
            names_of = tables.column_names(long, "column")
            wide = tables.pivot_long(long, index, "column", "value", names_of, repeated=True)
        kept = tables.where(wide, index, comparisons)
        if ROW in kept.columns:
            kept = kept.orderBy(ROW) if limit is None else kept
        elif limit is None:
            kept = kept.orderBy(*natural_order([index]))
        kept = tables.select_columns(kept.drop(ROW), index, columns)
        return DataResult(
            tables.page(kept, index, limit, offset),
            index,
            tuple(sorted({k["datatype"] for k in kinds if k["datatype"]})),
            tuple({k["gct"] for k in kinds}),
            bool(columns),
        )
