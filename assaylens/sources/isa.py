"""Archives of annotation tabs: unpacking, headers, rows, investigation records.

What a column means (which field it is, which column qualifies which) depends on
the header of a tab only. It is worked out once per tab and joined to the rows,
so a row is read in place, by position, and its cells are never shuffled.
"""

from __future__ import annotations

import csv
import io
import os
import re
import zipfile
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylens.errors import guarded
from assaylens.functions.text import (
    LIST_SEPARATOR,
    braces,
    capitalised,
    harmonised_key,
    header_extra,
    header_field,
    header_subfield,
    is_empty,
    with_unit,
)
from assaylens.operators.documents import branches, listed_items, record_document, row_document, text_places
from assaylens.operators.ranking import few, join_back
from assaylens.operators.shape import drop_empty

# Names of archive members, and of the entities records describe.
MEMBER_PATTERN = r"^([isa])_(.+)\.txt$"
ENTITY_PATTERN = {"Study": r"^s_(.+)\.txt$", "Study Assays": r"^a_(.+)\.txt$"}
ENTITY_KEY = {"Study": "Study File Name", "Study Assays": "Study Assay File Name"}
COMMENT_PATTERN = r"^Comment\s*\[\s*(.+[^\s]\s*)\]\s*$"
# The category of what a tab describes.
CATEGORY = {"s": "study", "a": "assay"}
# Sections of an investigation, and the one that has exactly one record.
SECTIONS = (
    "Ontology Source Reference",
    "Investigation",
    "Investigation Publications",
    "Investigation Contacts",
    "Study",
    "Study Design Descriptors",
    "Study Publications",
    "Study Factors",
    "Study Assays",
    "Study Protocols",
    "Study Contacts",
)
SINGLE_RECORD = "Investigation"
# Texts that stand for a missing cell.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)
# Header fields that qualify the main field to their left.
QUALIFIERS = ("Term Accession Number", "Unit", "Comment")
REFERENCE_SUFFIX = " REF"
PROTOCOL = "Protocol REF"
PARAMETER = "Parameter Value"
SAMPLE_NAME = "Sample Name"

LINE_SCHEMA = "accession string, kind string, tab string, line_no bigint, cells array<string>"
TAB = ("accession", "kind", "tab")
_BATCH_LINES = 10_000
_BATCH_CHARACTERS = 4 << 20  # of cells; the lines of a batch may be long


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(accession, content) of the ZIP archives below a folder, named by their file."""
    files = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+?)(_metadata_[^/]*)?\.zip$", 1)
    return files.select(name.alias("accession"), "content")


BROKEN = "!"  # the kind of a row that tells, as its tab, why an archive cannot be read
_LONGEST_CELL = 2**31 - 1


def _member_lines(text: Iterable[str]) -> Iterator[list[str]]:
    """Cells of the lines of one tab, without comment lines and blank lines."""
    kept = (line for line in text if not line.startswith("#"))
    for cells in csv.reader(kept, delimiter="\t", strict=True):
        if cells:
            yield cells


def _repaired_lines(text: str) -> list[list[str]]:
    """Cells of a tab whose quotes do not add up, read line by line.

    Quotes around a whole cell are taken off, those inside it stay. A cell that only
    begins or only ends with a quote cannot be told from one that goes on in the next
    line, which is an error.
    """
    out = []
    for line in text.splitlines():
        if not line or line.startswith("#"):
            continue
        cells = line.split("\t")
        for cell in cells:
            if len(cell) == 1 and cell == '"' or cell.startswith('"') != cell.endswith('"'):
                raise csv.Error("a quote is not closed")
        out.append([c[1:-1].replace('""', '"') if c.startswith('"') else c for c in cells])
    return out


def tab_lines(raw: io.BufferedIOBase, kind: str) -> Iterator[list[str]]:
    """The lines of a member. Records of an investigation are few: they are read as a
    whole, so that they can be repaired; other tabs are unpacked as they are read."""
    text = io.TextIOWrapper(raw, errors="replace", newline="", encoding="utf-8")
    if kind != "i":
        yield from _member_lines(text)
        return
    whole = text.read()
    try:
        lines = list(_member_lines(io.StringIO(whole, newline="")))
    except csv.Error:
        lines = _repaired_lines(whole)
    yield from lines


def _archive_rows(accession: str, content: bytes) -> Iterator[tuple]:
    """The rows of one archive; a member of the same kind and name in a later folder adds to it."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        for member in archive.namelist():
            found = re.search(MEMBER_PATTERN, os.path.basename(member))
            if found:
                with archive.open(member) as raw:
                    for number, cells in enumerate(tab_lines(raw, found[1])):
                        yield accession, found[1], found[2], number, cells


def _unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["accession", "kind", "tab", "line_no", "cells"]
    before = csv.field_size_limit(_LONGEST_CELL)
    try:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for accession, content in zip(batch["accession"], batch["content"]):
                try:
                    for row in _archive_rows(accession, content):
                        rows.append(row)
                        size += sum(map(len, row[4]))
                        if len(rows) == _BATCH_LINES or size > _BATCH_CHARACTERS:
                            yield pd.DataFrame(rows, columns=names)
                            rows, size = [], 0
                except csv.Error:
                    rows.append((accession, BROKEN, "quotes of a tab do not add up", 0, None))
                except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, TypeError):
                    rows.append((accession, BROKEN, "archive cannot be unpacked", 0, None))
            if rows:
                yield pd.DataFrame(rows, columns=names)
    finally:
        csv.field_size_limit(before)


def archive_lines(archives: DataFrame) -> DataFrame:
    """(accession, kind, tab, line_no, cells) of every line of every tab.

    An archive that cannot be read gives, beside what was read of it, a row of the kind
    ``BROKEN``; the others are read all the same.
    """
    return archives.select("accession", "content").mapInPandas(_unzip, LINE_SCHEMA)


def broken_archives(lines: DataFrame) -> DataFrame:
    """(accession, reason) of the archives that cannot be read."""
    # several tasks may tell the same of one archive
    return lines.filter(F.col("kind") == BROKEN).select("accession", F.col("tab").alias("reason")).distinct()


def unnamed_tabs(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """Study and assay tabs without a column of sample names."""
    named = parsed.filter(F.col("field") == SAMPLE_NAME).select(*TAB)
    return tab_headers(lines).select(*TAB).join(named, list(TAB), "left_anti")


def missing_tabs(archives: DataFrame, lines: DataFrame) -> DataFrame:
    """(accession, kind) of the tabs an archive should have but has not."""
    kinds = archives.select("accession").distinct().select(
        "accession", F.explode(F.array(*map(F.lit, "isa"))).alias("kind")
    )
    return kinds.join(lines.select("accession", "kind").distinct(), ["accession", "kind"], "left_anti")


def tab_headers(lines: DataFrame) -> DataFrame:
    """Header cells of each study and assay tab."""
    heads = lines.filter((F.col("line_no") == 0) & F.col("kind").isin("s", "a"))
    return heads.select(*TAB, F.col("cells").alias("header"))


def tab_rows(lines: DataFrame) -> DataFrame:
    """(accession, kind, tab, line_no, cells): distinct rows with blanks as NULL."""
    body = lines.filter((F.col("line_no") > 0) & F.col("kind").isin("s", "a"))
    cleaned = F.transform("cells", lambda c: F.when(~c.isin(*NULL_TOKENS), c))
    return (
        body.groupBy(*TAB, cleaned.alias("cells")).agg(F.min("line_no").alias("line_no"))
    ).select(*TAB, "line_no", "cells")


def parsed_headers(headers: DataFrame) -> DataFrame:
    """(tab..., pos, field, subfield, extra, role, ref_pos, main_no) per header cell.

    ``role`` is ``reference``, ``qualifier`` or ``main``. ``ref_pos`` is the last
    protocol reference to the left and ``main_no`` numbers the main fields. The
    windows run over the columns of one tab.
    """
    cells = headers.select(*TAB, F.posexplode("header").alias("pos", "column"))
    cells = cells.filter(F.col("column").isNotNull() & ~F.col("column").isin(*NULL_TOKENS))
    parsed = cells.select(
        *TAB,
        "pos",
        "column",
        header_field(F.col("column")).alias("field"),
        header_subfield(F.col("column")).alias("subfield"),
        header_extra(F.col("column")).alias("extra"),
    )
    field = F.col("field")
    role = (
        F.when(field == PROTOCOL, "reference")
        .when(field.isin(*QUALIFIERS) | field.endswith(REFERENCE_SUFFIX), "qualifier")
        .otherwise("main")
    )
    left = Window.partitionBy(*TAB).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        parsed.withColumn("role", role)
        .withColumn(
            "ref_pos",
            F.last(F.when(F.col("role") == "reference", F.col("pos")), ignorenulls=True).over(left),
        )
        .withColumn("main_no", F.sum(F.when(F.col("role") == "main", 1).otherwise(0)).over(left))
    )


def early_qualifiers(parsed: DataFrame) -> DataFrame:
    """Qualifiers that no main field precedes."""
    return parsed.filter((F.col("role") == "qualifier") & (F.col("main_no") == 0)).select(
        *TAB, "pos", "column"
    )


def duplicate_fields(parsed: DataFrame) -> DataFrame:
    """``field[subfield]`` that occurs twice in a tab."""
    both = parsed.filter((F.col("role") == "main") & F.col("subfield").isNotNull())
    return both.groupBy(*TAB, "field", "subfield").count().filter("count > 1")


def colliding_fields(parsed: DataFrame) -> DataFrame:
    """Different fields of a tab that get the same annotation path."""
    fields = parsed.filter(F.col("role") == "main").withColumn("path", _path("field", "subfield"))
    names = F.struct("field", F.coalesce("subfield", F.lit("")))
    return (
        fields.groupBy(*TAB, "path")
        .agg(F.min(names).alias("first"), F.max(names).alias("last"))
        .filter(F.col("first") != F.col("last"))
    )


def extra_on_qualifiers(parsed: DataFrame) -> DataFrame:
    """Warnings: brackets after a qualifier that takes none."""
    return parsed.filter(
        (F.col("role") == "qualifier") & (F.col("field") != "Comment") & F.col("subfield").isNotNull()
    ).select(*TAB, "column", F.lit("text after a qualifier is not used").alias("warning"))


def layouts(headers: DataFrame) -> DataFrame:
    """(tab..., name_places, layout, slots, branches, text_places): where in a row what is to be found.

    ``name_places`` lists the sample name columns; ``layout`` holds, for each main
    field, the positions of all that belongs to it; ``slots`` the same by path, and
    ``branches`` by the keys of documents; ``text_places`` lists where the texts of documents are. They are worked out once, and those of few tabs
    go to the rows, so that the rows of a tab stay where they are.

    A qualifier without a main field before it, or a repeated ``field[subfield]``,
    is an error.
    """
    parsed = parsed_headers(headers)
    early = (F.col("role") == "qualifier") & (F.col("main_no") == 0)
    parsed = parsed.withColumn(
        "main_no",
        guarded(F.col("main_no"), early, "a tab begins with a column that describes another column", F.col("accession"), F.col("column")),
    )
    main = F.col("role") == "main"
    takes_reference = F.col("subfield").isNull() | (F.col("field") == PARAMETER)
    qualifier = F.when(
        F.col("role") == "qualifier",
        F.struct("pos", "field", F.coalesce("subfield", F.lit("")).alias("subfield")),
    )
    fields = (
        parsed.filter((F.col("role") != "reference") & (F.col("main_no") > 0))
        .groupBy(*TAB, "main_no")
        .agg(
            F.max(F.when(main, F.struct("pos", "field", "subfield", "extra"))).alias("m"),
            F.max(F.when(main & takes_reference, F.col("ref_pos"))).alias("ref_pos"),
            F.max(F.when(F.col("field") == "Unit", F.col("pos"))).alias("unit_pos"),
            F.max(F.when(F.col("field") == "Term Accession Number", F.col("pos"))).alias("term_pos"),
            F.sort_array(F.collect_list(qualifier)).alias("qualifiers"),
        )
    )
    # a repeated top-level field is a list: number its occurrences
    same = Window.partitionBy(*TAB, "m.field", "m.subfield").orderBy("m.pos")
    fields = fields.withColumn("_ord", F.row_number().over(same) - 1)
    repeated = (F.col("_ord") > 0) & F.col("m.subfield").isNotNull()
    message = "two columns of a tab have the same field and subfield"
    names = (F.col("accession"), F.col("m.field"), F.col("m.subfield"))
    fields = fields.withColumn("ord", guarded(F.col("_ord"), repeated, message, *names))
    comments = F.filter("qualifiers", lambda q: q.getField("field") == "Comment")
    references = F.filter("qualifiers", lambda q: q.getField("field").endswith(REFERENCE_SUFFIX))
    entry = F.struct(
        "m.pos", "m.field", "m.subfield", "m.extra", "ord", "ref_pos", "unit_pos", "term_pos",
        _last_by_name(comments, "subfield").alias("comments"),
        _last_by_name(references, "field").alias("references"),
    )
    entries = fields.select(*TAB, _path("m.field", "m.subfield").alias("path"), entry.alias("e"))
    # one slot per annotation path: where its values and their units are
    slots = entries.groupBy(*TAB, "path").agg(
        F.sort_array(F.collect_list("e")).alias("es"),
        F.min(F.struct("e.field", "e.subfield")).alias("_first"),
        F.max(F.struct("e.field", "e.subfield")).alias("_last"),
    )
    path = guarded(
        F.col("path"), F.col("_first") != F.col("_last"), "two fields of a tab become one key; rename one of them", F.col("path")
    )
    places = F.transform("es", lambda e: F.struct(e.getField("pos"), e.getField("unit_pos")))
    is_name = (F.col("_first.field") == SAMPLE_NAME) & F.col("_first.subfield").isNull()
    per_tab = slots.groupBy(*TAB).agg(
        F.flatten(F.collect_list(F.when(is_name, F.transform("es", lambda e: e.getField("pos"))))).alias(
            "name_places"
        ),
        F.sort_array(F.flatten(F.collect_list("es"))).alias("layout"),
        F.collect_list(F.struct(path.alias("path"), places.alias("places"))).alias("slots"),
    )
    described = per_tab.withColumn("branches", branches(F.col("layout")))
    return few(described.withColumn("text_places", text_places(F.col("branches"))))


def _path(field: str, subfield: str) -> Column:
    category = F.element_at(
        F.create_map(*[F.lit(x) for pair in CATEGORY.items() for x in pair]), F.col("kind")
    )
    keys = [harmonised_key(F.col(c)) for c in (field, subfield)]
    return F.concat_ws(".", category, *keys)


def _last_by_name(items: Column, name: str) -> Column:
    """Distinct names of positioned items with the last position of each."""
    names = F.array_distinct(F.transform(items, lambda i: i.getField(name)))
    places = F.transform(
        names,
        lambda n: F.array_max(
            F.transform(F.filter(items, lambda i: i.getField(name) == n), lambda i: i.getField("pos"))
        ),
    )
    return F.struct(names.alias("names"), places.alias("places"))


def _cell(position: Column) -> Column:
    return F.get("cells", position)


def _read(m: Column) -> Column:
    """What a row holds for an entry of its layout."""

    def named(items: Column) -> Column:
        places = items.getField("places")
        return F.map_from_arrays(items.getField("names"), F.transform(places, _cell))

    return F.struct(
        m.getField("field").alias("field"),
        m.getField("subfield").alias("subfield"),
        m.getField("extra").alias("extra"),
        m.getField("ord").alias("ord"),
        _cell(m.getField("pos")).alias("value"),
        _cell(m.getField("ref_pos")).alias("protocol_ref"),
        _cell(m.getField("unit_pos")).alias("unit"),
        _cell(m.getField("term_pos")).alias("term"),
        named(m.getField("comments")).alias("comment"),
        named(m.getField("references")).alias("references"),
    )


def _read_described(m: Column) -> Column:
    """``_read`` for documents: without maps for the many entries that nothing describes."""
    plain = _read(m)

    def named(name: str, items: Column) -> Column:
        return F.when(F.size(items.getField("names")) > 0, plain.getField(name)).alias(name)

    kept = [plain.getField(c).alias(c) for c in ("value", "protocol_ref", "unit", "term")]
    return F.struct(
        *kept, named("comment", m.getField("comments")), named("references", m.getField("references"))
    )


def read_fields(rows: DataFrame, tab_layouts: DataFrame) -> DataFrame:
    """Rows with ``fields``: value, unit, protocol and comments of each main field."""
    joined = join_back(rows, tab_layouts.select(*TAB, "layout"), TAB)
    return joined.withColumn("fields", F.transform("layout", _read)).drop("layout")


def annotate(
    rows: DataFrame, tab_layouts: DataFrame, formatter: Callable[[Column, Column], Column] = braces
) -> DataFrame:
    """Rows with ``attrs``: values by dotted path, straight from the cells.

    Values are merged with their units, empty ones are left out, and a repeated
    field becomes one text with its values separated by ``, ``.
    """

    def shown(place: Column) -> Column:
        value, unit = _cell(place.getField("pos")), _cell(place.getField("unit_pos"))
        return F.when(~is_empty(value), with_unit(value, unit, formatter))

    joined = join_back(rows, tab_layouts.select(*TAB, "slots"), TAB)
    texts = F.transform(
        "slots", lambda s: F.array_join(F.transform(s.getField("places"), shown), ", ")
    )
    attrs = F.map_from_arrays(F.transform("slots", lambda s: s.getField("path")), texts)
    return joined.withColumn("attrs", drop_empty(attrs)).drop("slots")


def with_row_documents(rows: DataFrame, tab_layouts: DataFrame) -> DataFrame:
    """Rows with ``document``: their fields with all that describes them."""
    joined = join_back(rows, tab_layouts.select(*TAB, "branches"), TAB)
    return joined.withColumn("document", row_document(F.col("branches"), _read_described)).drop("branches")


def with_row_elements(rows: DataFrame, tab_layouts: DataFrame) -> DataFrame:
    """Rows with ``elements``: the distinct items of the texts of their documents, read from the cells."""
    joined = join_back(rows, tab_layouts.select(*TAB, "text_places"), TAB)
    texts = F.filter(F.transform("text_places", _cell), lambda t: ~is_empty(t))
    items = F.flatten(F.transform(texts, lambda t: F.split(t, LIST_SEPARATOR)))
    return joined.withColumn("elements", F.array_distinct(items)).drop("text_places")


def with_names(rows: DataFrame, tab_layouts: DataFrame) -> DataFrame:
    """Rows with ``sample_names``: the distinct contents of their sample name columns."""
    joined = join_back(rows, tab_layouts.select(*TAB, "name_places"), TAB)
    names = F.array_distinct(F.transform("name_places", _cell))
    missing = guarded(names, F.size("name_places") == 0, "a tab has no Sample Name column", *map(F.col, TAB))
    return joined.withColumn("sample_names", missing).drop("name_places")


def _first_name() -> Column:
    return F.get("sample_names", F.lit(0))


def unnamed_rows(rows: DataFrame) -> DataFrame:
    """Warnings: rows whose sample name is missing."""
    return rows.filter(_first_name().isNull()).select(
        *TAB, "line_no", F.lit("row left out: it names no sample").alias("warning")
    )


def conflicting_names(rows: DataFrame) -> DataFrame:
    """Rows whose sample name columns disagree."""
    return rows.filter(F.size("sample_names") > 1).select(*TAB, "line_no")


def duplicate_samples(named: DataFrame) -> DataFrame:
    """Sample names that occur twice in the study tabs of a dataset."""
    studies = named.filter(F.col("kind") == "s")
    return studies.groupBy("accession", "sample_name").count().filter("count > 1")


def first_names(rows: DataFrame) -> DataFrame:
    """Rows with a ``sample_name``, the first one where their columns disagree."""
    return rows.withColumn("sample_name", _first_name()).filter(F.col("sample_name").isNotNull())


def named_rows(rows: DataFrame) -> DataFrame:
    """Rows with their one ``sample_name``; those without one drop out."""
    name = guarded(
        _first_name(),
        F.size("sample_names") > 1,
        "a row names several samples",
        F.col("accession"),
        F.col("line_no"),
    )
    named = rows.filter(_first_name().isNotNull() | (F.size("sample_names") > 1))
    return named.withColumn("sample_name", name).drop("sample_names")


# --- investigation ------------------------------------------------------------------


def investigation_cells(lines: DataFrame) -> DataFrame:
    """(accession, section, block, record, key, line_no, value) of the investigation tab.

    A line of one capitalised cell opens a section; in the lines below it the
    first cell is the key and each further cell belongs to one record. ``block``
    numbers the sections of a file, as a section may occur once per study.
    """
    own = lines.filter(F.col("kind") == "i")
    head = F.get("cells", F.lit(0))
    title = F.initcap(F.lower(F.trim(head)))
    opens = title.isin(*SECTIONS) & (F.trim(head) == F.upper(F.trim(head)))
    before = Window.partitionBy("accession", "tab").orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, 0
    )
    marked = (
        own.withColumn("_opens", opens)
        .withColumn("section", F.last(F.when(F.col("_opens"), title), ignorenulls=True).over(before))
        .withColumn("block", F.sum(F.col("_opens").cast("int")).over(before))
        .filter(~F.col("_opens") & F.col("section").isNotNull())
    )
    return (
        marked.select(
            "accession",
            "section",
            "block",
            "line_no",
            F.trim(head).alias("key"),
            F.posexplode(F.slice("cells", 2, F.greatest(F.size("cells") - 1, F.lit(0)))).alias(
                "record", "value"
            ),
        )
        .withColumn("value", F.when(~F.col("value").isin(*NULL_TOKENS), F.col("value")))
    )


def comment_key(key: Column) -> Column:
    """Capitalised name inside ``Comment[...]``, NULL for other keys."""
    return F.when(key.rlike(COMMENT_PATTERN), capitalised(F.regexp_extract(key, COMMENT_PATTERN, 1)))


def fold_comments(cells: DataFrame, entity: Sequence[str]) -> DataFrame:
    """(entity..., comment, values): comments of a record; equal values become one."""
    found = cells.withColumn("comment", comment_key(F.col("key"))).filter("comment IS NOT NULL")
    values = F.transform(
        F.sort_array(F.collect_list(F.struct("line_no", "value"))), lambda s: s.getField("value")
    )
    return (
        found.groupBy(*entity, "comment")
        .agg(values.alias("values"))
        .withColumn(
            "values",
            F.when(F.size(F.array_distinct("values")) == 1, F.slice("values", 1, 1)).otherwise(
                F.col("values")
            ),
        )
    )


def investigation_records(cells: DataFrame) -> DataFrame:
    """(accession, section, block, record, content): one map per record.

    Comments are left to ``fold_comments``; a record without any value is dropped.
    """
    plain = cells.filter(comment_key(F.col("key")).isNull())
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value"))))
    return (
        plain.groupBy("accession", "section", "block", "record")
        .agg(pairs.alias("content"), F.count("value").alias("_filled"))
        .filter("_filled > 0")
        .drop("_filled")
    )


def with_documents(records: DataFrame, cells: DataFrame) -> DataFrame:
    """Records with ``document``: their keys and their folded comments."""
    entity = ["accession", "section", "block", "record"]
    folded = fold_comments(cells, entity).groupBy(*entity)
    comments = folded.agg(F.sort_array(F.collect_list(F.struct("comment", "values"))).alias("comments"))
    joined = join_back(records, comments, entity, "left")
    none = F.array().cast("array<struct<comment: string, values: array<string>>>")
    document = record_document(F.col("content"), F.coalesce("comments", none))
    return joined.withColumn("document", document).drop("comments")


def with_elements(records: DataFrame) -> DataFrame:
    """Records with ``elements``: the distinct items of the texts of their documents."""
    entity = ["accession", "section", "block", "record"]
    items = listed_items(records, entity).groupBy(*entity).agg(F.collect_set("item").alias("elements"))
    joined = join_back(records, items, entity, "left")
    return joined.withColumn("elements", F.coalesce("elements", F.array().cast("array<string>")))


def _documents(df: DataFrame) -> list[str]:
    """The columns of documents and of their elements, if there are any."""
    return [c for c in ("document", "elements") if c in df.columns]


def record_attrs(content: Column, section: str) -> Column:
    """Annotation map of a record: ``investigation.<section>.<key>``, without empty values."""
    prefix = f"investigation.{section.lower()}."
    return drop_empty(
        F.transform_keys(content, lambda k, _: F.concat(F.lit(prefix), harmonised_key(k)))
    )


def entity_records(records: DataFrame, section: str) -> DataFrame:
    """Records of studies or assays by the name their file name holds."""
    file_name = F.col("content").getItem(ENTITY_KEY[section])
    pattern = ENTITY_PATTERN[section]
    return (
        records.filter(F.col("section") == section)
        .withColumn("entity", F.when(file_name.rlike(pattern), F.regexp_extract(file_name, pattern, 1)))
        .select("accession", "section", "block", "record", "entity", "content", *_documents(records))
    )


def unnamed_entities(records: DataFrame, section: str) -> DataFrame:
    """Records whose file name does not hold a name."""
    return entity_records(records, section).filter(F.col("entity").isNull()).drop("content")


def wrong_record_counts(records: DataFrame) -> DataFrame:
    """Datasets whose investigation section has more than one record."""
    single = F.count_if(F.col("section") == SINGLE_RECORD).alias("n_records")
    return records.groupBy("accession").agg(single).filter("n_records > 1")
