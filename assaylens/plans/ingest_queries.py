"""Registered queries on sources and shaping: tables, archives, tabs, listings."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylens.errors import raise_if_any
from assaylens.functions import text
from assaylens.ingest import build_samples, ingest, ingest_folder
from assaylens.operators import analytics, documents, shape
from assaylens.operators.predicates import matches
from assaylens.plans import fixtures as fx
from assaylens.plans.registry import query
from assaylens.session import scratch_path, shared_folder
from assaylens.sources import archives, isa, listing, tables

_WIDE_SCHEMA = T.StructType(
    [T.StructField("feature", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in ("a1", "n1", "r1")]
)


def _as_csv(df, spark, name, sep=","):
    """The frame as delimited files in the shared folder."""
    path = scratch_path(spark, name)
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


@query("s1_read_table", "SELECT feature, a1, n1, r1 FROM fx_wide1")
def s1(spark, sf_dir):
    """A tab-separated table, its delimiter and types found by looking at it."""
    path = _as_csv(fx.wide(spark, sf_dir, 1), spark, "table", sep="\t")
    return tables.read_table(spark, path)


@query(
    "s3_bulk_load",
    """SELECT feature, a1, n1, r1, CAST(1600000000 AS BIGINT) AS source_ts, 'GLDS-1' AS accession FROM fx_wide1
       UNION ALL SELECT feature, a2, n2, r2, 1600000500, 'GLDS-2' FROM fx_wide2""",
)
def s3(spark, sf_dir):
    """Two datasets loaded one after the other; the first one twice."""
    target = scratch_path(spark, "loaded")
    first = [_as_csv(fx.wide(spark, sf_dir, 1), spark, "first")]
    second = [_as_csv(fx.wide(spark, sf_dir, 2).toDF("feature", "a1", "n1", "r1"), spark, "second")]
    for accession, ts, paths in (
        ("GLDS-1", 1_500_000_000, first),
        ("GLDS-2", 1_600_000_500, second),
        ("GLDS-1", 1_600_000_000, first),
    ):
        tables.load_tables(spark, paths, accession, ts, target, _WIDE_SCHEMA)
    return spark.read.parquet(target)


_INVESTIGATION = """INVESTIGATION
Investigation Title\tOrders
STUDY
Study File Name\ts_first.txt
Study Title\tPrices
STUDY ASSAYS
Study Assay File Name\ta_first.txt
Study Assay Technology Type\tDNA Microarray
"""


def _zipped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One archive of three tabs per batch of orders."""
    for batch in batches:
        if batch.empty:
            continue
        name = f"DS-{batch['o_orderkey'].iloc[0]}"
        study = ["Source Name\tSample Name\tCharacteristics[Price]"]
        assay = ["Sample Name\tParameter Value[status]"]
        for row in batch.itertuples():
            study.append(f'src{row.o_custkey}\t"smp{row.o_orderkey}"\t{row.price}')
            assay.append(f"smp{row.o_orderkey}\t{row.o_orderstatus}")
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(f"{name}/i_all.txt", _INVESTIGATION)
            archive.writestr(f"{name}/s_first.txt", "# a comment\n" + "\n".join(study))
            archive.writestr(f"{name}/a_first.txt", "\n".join(assay))
            archive.writestr(f"{name}/readme.md", "not a tab")
        yield pd.DataFrame({"accession": [name], "content": [out.getvalue()]})


def _archives(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.floor("o_totalprice").cast("bigint").alias("price")
    )
    return orders.mapInPandas(_zipped, "accession string, content binary")


@query(
    "s4_archive_lines",
    """SELECT 's' AS kind, 'first' AS tab, concat('src', o_custkey, '|smp', o_orderkey, '|',
              CAST(floor(o_totalprice) AS BIGINT)) AS line FROM orders
       UNION ALL SELECT 'a', 'first', concat('smp', o_orderkey, '|', o_orderstatus) FROM orders""",
)
def s4(spark, sf_dir):
    lines = isa.archive_lines(_archives(spark, sf_dir))
    body = lines.filter((F.col("line_no") > 0) & (F.col("kind") != "i"))
    return body.select("kind", "tab", F.concat_ws("|", "cells").alias("line"))


@query(
    "s4_large_archive",
    """SELECT accession, kind, 'first' AS tab,
              CAST(row_number() OVER (PARTITION BY accession, kind ORDER BY n) - 1 AS BIGINT) AS line_no, line
       FROM (
           SELECT CASE WHEN o_orderkey % 10 = 0 THEN concat('GLDS-', o_custkey % 3 + 2) ELSE 'GLDS-1' END AS accession,
                  's' AS kind, o_orderkey AS n,
                  concat('src', o_custkey, '|a "quoted" name', chr(10), 'of two lines ', o_orderkey, '|', o_orderpriority) AS line
           FROM orders
           UNION ALL
           SELECT CASE WHEN o_orderkey % 10 = 0 THEN concat('GLDS-', o_custkey % 3 + 2) ELSE 'GLDS-1' END, 'a',
                  o_orderkey, concat('smp', o_orderkey, '|', o_orderstatus) FROM orders)""",
)
def s4_large(spark, sf_dir):
    """Archives in a folder, one of them with most of the lines; it is read in ranges."""
    key = F.col("o_orderkey")
    accession = F.when(key % 10 == 0, fx.numbered("GLDS-", F.col("o_custkey") % 3 + 2)).otherwise("GLDS-1")
    orders = fx.table(spark, sf_dir, "orders")

    def tab(kind, *cells):
        return orders.select(
            accession.alias("accession"),
            F.lit(kind).alias("kind"),
            F.lit("first").alias("tab"),
            key.cast("bigint").alias("line_no"),
            F.array(*cells).alias("cells"),
        )

    name = F.concat(F.lit('a "quoted" name\nof two lines '), key.cast("string"))
    studies = tab("s", fx.numbered("src", F.col("o_custkey")), name, F.col("o_orderpriority"))
    assays = tab("a", fx.numbered("smp", key), F.col("o_orderstatus"))
    folder = scratch_path(spark, "archives")
    archives.write_archives(studies.unionByName(assays), folder)
    lines = archives.scan_archives(spark, folder, range_bytes=1 << 16)
    return lines.select("accession", "kind", "tab", "line_no", F.concat_ws("|", "cells").alias("line"))


@query(
    "s5_distinct_rows",
    """SELECT concat('GLDS-', o_custkey % 5 + 1) AS accession,
              CAST(min(o_orderkey) + 1 AS BIGINT) AS line_no, concat('c', o_custkey % 50) AS source,
              CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, o_orderpriority AS priority
       FROM orders GROUP BY o_custkey % 5, o_custkey % 50, o_orderstatus, o_orderpriority""",
)
def s5(spark, sf_dir):
    """Rows repeat; a blank cell is a missing one."""
    orders = fx.table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("N/A")
    _, lines = fx.tab(
        orders,
        fx.numbered("GLDS-", F.col("o_custkey") % 5 + 1),
        F.col("o_orderkey"),
        [
            ("Source Name", fx.numbered("c", F.col("o_custkey") % 50)),
            ("Sample Name", status),
            ("Sample Name", F.col("o_orderpriority")),
        ],
    )
    cell = F.col("cells")
    return isa.tab_rows(lines).select(
        "accession",
        "line_no",
        cell[0].alias("source"),
        cell[1].alias("status"),
        cell[2].alias("priority"),
    )


_HEADER_SQL = r"'(.+[^\s])\s*\[\s*(.+[^\s])\s*\]\s*$'"


@query(
    "s6_parse_headers",
    f"""SELECT p_partkey, CASE WHEN regexp_matches(h, {_HEADER_SQL}) THEN regexp_extract(h, {_HEADER_SQL}, 1)
                               ELSE h END AS field,
               CASE WHEN regexp_matches(h, {_HEADER_SQL})
                    THEN split_part(regexp_extract(h, {_HEADER_SQL}, 2), ',', 1) END AS subfield,
               CASE WHEN regexp_matches(h, {_HEADER_SQL})
                    THEN array_to_string(string_split(regexp_extract(h, {_HEADER_SQL}, 2), ',')[2:], '|')
                    ELSE '' END AS extra
        FROM (SELECT p_partkey, CASE p_partkey % 3
            WHEN 0 THEN concat(p_type, ' [ ', p_name, ',http://x/', p_size, ',', p_brand, ' ] ')
            WHEN 1 THEN concat(p_type, '[', p_name, ']') ELSE p_type END AS h FROM part)""",
)
def s6(spark, sf_dir):
    key, kind, name = F.col("p_partkey"), F.col("p_type"), F.col("p_name")
    header = (
        F.when(
            key % 3 == 0,
            F.concat(
                kind, F.lit(" [ "), name, F.lit(",http://x/"), F.col("p_size").cast("string"),
                F.lit(","), F.col("p_brand"), F.lit(" ] "),
            ),
        )
        .when(key % 3 == 1, F.concat(kind, F.lit("["), name, F.lit("]")))
        .otherwise(kind)
    )
    parsed = fx.table(spark, sf_dir, "part").select("p_partkey", header.alias("h"))
    h = F.col("h")
    return parsed.select(
        "p_partkey",
        text.header_field(h).alias("field"),
        text.header_subfield(h).alias("subfield"),
        F.array_join(text.header_extra(h), "|").alias("extra"),
    )


def _fields(spark, sf_dir):
    headers, lines = fx.cells(spark, sf_dir)
    rows = isa.read_fields(isa.tab_rows(lines), isa.layouts(headers))
    return rows.withColumn("row_id", F.col("line_no") - 1)


def _exploded(spark, sf_dir):
    return _fields(spark, sf_dir).select("row_id", F.explode("fields").alias("f")).select("row_id", "f.*")


@query("s7_protocol_references", "SELECT row_id, field, subfield, value, protocol_ref FROM fx_fields")
def s7(spark, sf_dir):
    return _exploded(spark, sf_dir).select("row_id", "field", "subfield", "value", "protocol_ref")


@query("s8_qualifiers", "SELECT row_id, field, subfield, value, unit FROM fx_fields")
def s8(spark, sf_dir):
    return _exploded(spark, sf_dir).select("row_id", "field", "subfield", "value", "unit")


@query(
    "s9_repeated_fields",
    """SELECT o_orderkey AS row_id, 'Raw Data File' AS field, CAST(k AS INTEGER) AS ord,
              CASE k WHEN 0 THEN concat(o_orderkey, '_R1.fastq') ELSE concat(o_orderkey, '_R2.fastq') END AS value,
              CASE k WHEN 1 THEN o_orderpriority END AS mood
       FROM orders, (VALUES (0), (1)) AS n(k)
       UNION ALL SELECT o_orderkey, 'Sample Name', 0, concat('smp', o_orderkey), NULL FROM orders""",
)
def s9(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    headers, lines = fx.tab(
        orders,
        fx.numbered("GLDS-", F.col("o_custkey") % 5 + 1),
        F.col("o_orderkey"),
        [
            ("Sample Name", F.concat(F.lit("smp"), key)),
            ("Raw Data File", F.concat(key, F.lit("_R1.fastq"))),
            ("Raw Data File", F.concat(key, F.lit("_R2.fastq"))),
            ("Comment[mood]", F.col("o_orderpriority")),
        ],
        kind="a",
    )
    rows = isa.read_fields(isa.tab_rows(lines), isa.layouts(headers))
    return rows.select((F.col("line_no") - 1).alias("row_id"), F.explode("fields").alias("f")).select(
        "row_id", "f.field", "f.ord", "f.value", F.try_element_at("f.comment", F.lit("mood")).alias("mood")
    )


def _sample_tab(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    headers, lines = fx.tab(
        orders,
        fx.numbered("GLDS-", F.col("o_custkey") % 5 + 1),
        key,
        [
            ("Source Name", fx.numbered("src", key)),
            ("Sample Name", F.when(key % 10 != 0, fx.numbered("smp", key))),
            ("Factor Value[Status]", F.col("o_orderstatus")),
        ],
    )
    return isa.with_names(isa.tab_rows(lines), isa.layouts(headers))


@query(
    "s10_named_rows",
    """SELECT concat('GLDS-', o_custkey % 5 + 1) AS accession, concat('smp', o_orderkey) AS sample_name
       FROM orders WHERE o_orderkey % 10 <> 0""",
)
def s10(spark, sf_dir):
    return isa.named_rows(_sample_tab(spark, sf_dir)).select("accession", "sample_name")


@query(
    "s10_unnamed_rows",
    """SELECT concat('GLDS-', o_custkey % 5 + 1) AS accession, CAST(o_orderkey + 1 AS BIGINT) AS line_no,
              'row left out: it names no sample' AS warning FROM orders WHERE o_orderkey % 10 = 0""",
)
def s10_unnamed(spark, sf_dir):
    return isa.unnamed_rows(_sample_tab(spark, sf_dir)).select("accession", "line_no", "warning")


def _investigations(spark, sf_dir):
    """One investigation tab per customer."""
    customers = fx.table(spark, sf_dir, "customer")
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    other = F.when(F.col("c_custkey") % 2 == 0, segment).otherwise(F.lower(segment))
    blank = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(fx.numbered("Study of ", F.col("c_nationkey")))
    lines = [
        [F.lit("INVESTIGATION")],
        [F.lit("Investigation Identifier"), name],
        [F.lit("STUDY")],
        [F.lit("Study File Name"), F.concat(F.lit("s_"), name, F.lit(".txt"))],
        [F.lit("Study Title"), blank],
        [F.lit("Comment[ mission tag]"), segment],
        [F.lit("Comment[Mission Tag]"), other],
        [F.lit("STUDY ASSAYS")],
        [F.lit("Study Assay File Name")]
        + [F.concat(F.lit("a_"), name, F.lit(f"_{k}.txt")) for k in (1, 2)],
        [F.lit("Study Assay Technology Type"), segment, F.lit("DNA Microarray")],
    ]
    entries = F.array(
        *[
            F.struct(F.lit(i).cast("bigint").alias("line_no"), F.array(*cells).alias("cells"))
            for i, cells in enumerate(lines)
        ]
    )
    exploded = customers.select(name.alias("accession"), F.explode(entries).alias("l"))
    return exploded.select(
        "accession", F.lit("i").alias("kind"), F.lit("all").alias("tab"), "l.line_no", "l.cells"
    )


@query(
    "s11_investigation_records",
    """SELECT c_name AS accession, c_name AS entity, 'Study File Name' AS key,
              concat('s_', c_name, '.txt') AS value FROM customer
       UNION ALL SELECT c_name, c_name, 'Study Title', CASE WHEN c_custkey % 3 <> 0
              THEN concat('Study of ', c_nationkey) END FROM customer
       UNION ALL SELECT c_name, concat(c_name, '_', k), 'Study Assay File Name',
              concat('a_', c_name, '_', k, '.txt') FROM customer, (VALUES (1), (2)) AS n(k)
       UNION ALL SELECT c_name, concat(c_name, '_', k), 'Study Assay Technology Type',
              CASE k WHEN 1 THEN c_mktsegment ELSE 'DNA Microarray' END
              FROM customer, (VALUES (1), (2)) AS n(k)""",
)
def s11(spark, sf_dir):
    records = isa.investigation_records(isa.investigation_cells(_investigations(spark, sf_dir)))
    both = isa.entity_records(records, "Study").unionByName(isa.entity_records(records, "Study Assays"))
    return both.select("accession", "entity", F.explode("content").alias("key", "value"))


@query(
    "s12_folded_comments",
    """SELECT c_name AS accession, 'Study' AS section, 'Mission tag' AS comment,
              CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment
                   ELSE concat(c_mktsegment, '|', lower(c_mktsegment)) END AS all_values FROM customer""",
)
def s12(spark, sf_dir):
    cells = isa.investigation_cells(_investigations(spark, sf_dir))
    folded = isa.fold_comments(cells, ["accession", "section", "block", "record"])
    return folded.select(
        "accession", "section", "comment", F.array_join("values", "|").alias("all_values")
    )


@query(
    "s13_datasets",
    "SELECT accession, CAST(count(*) AS BIGINT) AS n_files FROM fx_listing GROUP BY 1",
)
def s13(spark, sf_dir):
    return listing.accessions(fx.listing(spark, sf_dir))


@query(
    "s14_typed_files",
    """SELECT accession, filename, version, datatype, type, joinable, gct_valid, internal,
              CASE WHEN gct_valid THEN 'sample name' END AS column_subset,
              CASE WHEN type = 'table' THEN true END AS cacheable
       FROM (SELECT l.*, t.datatype, t.type, t.joinable, t.gct_valid, t.internal
             FROM fx_listing l JOIN fx_typed t ON l.accession = t.accession AND l.filename = t.filename)""",
)
def s14(spark, sf_dir):
    return listing.typed_files(fx.listing(spark, sf_dir)).select(
        "accession", "filename", "version", "datatype", "type", "joinable", "gct_valid", "internal",
        "column_subset", "cacheable",
    )


@query("s15_timestamps", "SELECT accession, version, ts FROM fx_stamped")
def s15(spark, sf_dir):
    return listing.with_timestamp(fx.listing(spark, sf_dir)).select("accession", "version", "ts")


@query("s16_latest_files", "SELECT accession, filename, version, ts FROM fx_latest")
def s16(spark, sf_dir):
    return fx.latest(spark, sf_dir).select("accession", "filename", "version", "ts")


@query(
    "ingest_samples",
    """SELECT concat('smp', o_orderkey) AS sample_name, 'first' AS assay_name, 'first' AS study_name,
              CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price, o_orderstatus AS status,
              'DNA Microarray' AS technology, 'Prices' AS title, 'Orders' AS project,
              CASE WHEN o_orderstatus = 'F' THEN 'F,ISA.zip' ELSE 'ISA.zip' END AS files FROM orders""",
)
def ingest_samples(spark, sf_dir):
    """Archives and listings to sample rows; a file named like the status belongs to the sample."""
    shared_folder(spark)
    # the listing and several checks read the archives, which are made only once
    archives = _archives(spark, sf_dir).checkpoint()
    names = F.explode(F.array(F.lit("F"), F.lit("ISA.zip"), F.lit("other.txt")))
    files = archives.select("accession", names.alias("filename")).select(
        "accession",
        "filename",
        F.when(F.col("filename") == "ISA.zip", "isa").alias("datatype"),
        (F.col("filename") == "ISA.zip").alias("internal"),
        F.lit(None).cast("string").alias("condition"),
    )
    attrs = F.col("attrs")
    listed = F.array_sort(F.transform("files", lambda f: f.getField("filename")))
    return build_samples(archives, files).select(
        "sample_name",
        "assay_name",
        "study_name",
        attrs["study.characteristics.price"].alias("price"),
        attrs["assay.parameter value.status"].alias("status"),
        attrs[fx.TECHNOLOGY].alias("technology"),
        attrs["investigation.study.study title"].alias("title"),
        attrs["investigation.investigation.investigation title"].alias("project"),
        F.array_join(listed, ",").alias("files"),
    )


# --- shaping ---------------------------------------------------------------------------


@query(
    "h1_harmonised_keys",
    """SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '__id'
              ELSE lower(concat(p_type, '_', p_brand, '_cost')) END AS key
       FROM part""",
)
def h1(spark, sf_dir):
    key = F.when(F.col("p_partkey") % 7 == 0, "_ID").otherwise(
        F.concat("p_type", F.lit("."), "p_brand", F.lit("$Cost"))
    )
    rows = fx.table(spark, sf_dir, "part").select("p_partkey", key.alias("key"))
    return shape.harmonise_long(rows, ["p_partkey"])


@query(
    "h2_drop_empty",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'c' WHEN o_orderkey % 3 = 1 THEN 'a,c'
              ELSE 'b,c' END AS keys FROM orders""",
)
def h2(spark, sf_dir):
    key = F.col("o_orderkey")
    attrs = F.create_map(
        F.lit("a"), F.when(key % 3 == 1, "x").otherwise(""),
        F.lit("b"), F.when(key % 3 == 2, F.col("o_orderpriority")),
        F.lit("c"), F.col("o_orderstatus"),
    )
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", shape.drop_empty(attrs).alias("m"))
    return rows.select("o_orderkey", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"))


@query(
    "h3_values_with_units",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat(CAST(floor(o_totalprice) AS BIGINT), ' {usd}')
              ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END AS shown FROM orders""",
)
def h3(spark, sf_dir):
    key = F.col("o_orderkey")
    unit = F.when(key % 3 == 0, "usd").when(key % 3 == 1, "")
    value = F.floor("o_totalprice").cast("bigint").cast("string")
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", text.with_unit(value, unit).alias("shown"))


@query(
    "h4_flat_annotation",
    """SELECT row_id, concat('study.', lower(field), coalesce('.' || lower(subfield), '')) AS path,
              value || coalesce(' {' || unit || '}', '') AS value FROM fx_fields WHERE value IS NOT NULL""",
)
def h4(spark, sf_dir):
    headers, lines = fx.cells(spark, sf_dir)
    rows = isa.annotate(isa.tab_rows(lines), isa.layouts(headers))
    return rows.select((F.col("line_no") - 1).alias("row_id"), F.explode("attrs").alias("path", "value"))


_COMMENTED = """INVESTIGATION
Investigation Title\tOrders
Comment[Contact]\tdesk, second desk
STUDY
Study File Name\ts_first.txt
Study Title\tPrices
Comment[mission TAG]\tM1
Comment[Mission Tag]\tM1
Comment[Report]\treport.pdf
STUDY ASSAYS
Study Assay File Name\ta_first.txt
Study Assay Technology Type\tDNA Microarray
"""


def _commented(spark, sf_dir):
    """Samples of archives with comments below values and records, read from a folder."""
    orders = fx.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")

    def tab(kind, name, number, *cells):
        return orders.select(
            F.lit("GLDS-1").alias("accession"), F.lit(kind).alias("kind"), F.lit(name).alias("tab"),
            number.cast("bigint").alias("line_no"), F.array(*[F.lit(c) if isinstance(c, str) else c for c in cells]).alias("cells"),
        )

    study_head = ["Source Name", "Sample Name", "Characteristics[Price]", "Unit", "Comment[Bill]", "Raw Data File"]
    assay_head = ["Sample Name", "Parameter Value[status]", "Comment[Scan, first]"]
    bill = F.when(key % 4 != 0, F.concat(F.lit("bill"), (key % 8).cast("string"), F.lit(".csv , none")))
    parts = [
        tab("s", "first", key, fx.numbered("src", F.col("o_custkey")), fx.numbered("smp", key),
            F.floor("o_totalprice").cast("bigint").cast("string"), F.when(key % 3 != 0, "usd"), bill, "listed.bam"),
        tab("a", "first", key, fx.numbered("smp", key), F.col("o_orderstatus"),
            F.when(F.col("o_orderstatus") == "F", "scan.png")),
        tab("s", "first", F.lit(-1), *study_head).limit(1),
        tab("a", "first", F.lit(-1), *assay_head).limit(1),
    ]
    for number, line in enumerate(_COMMENTED.splitlines()):
        parts.append(tab("i", "all", F.lit(number), *line.split("\t")).limit(1))
    folder = scratch_path(spark, "archives")
    archives.write_archives(reduce(DataFrame.unionByName, parts), folder)
    names = ["ISA.zip", "scan.png", "report.pdf", "listed.bam", *[f"bill{n}.csv" for n in range(8)]]
    files = spark.createDataFrame([("GLDS-1", n) for n in names], "accession string, filename string").select(
        "accession",
        "filename",
        F.when(F.col("filename") == "ISA.zip", "isa").alias("datatype"),
        (F.col("filename") == "ISA.zip").alias("internal"),
        F.lit(None).cast("string").alias("condition"),
    )
    samples, failures = ingest_folder(spark, folder, files, range_bytes=1 << 20)
    raise_if_any(failures, "datasets cannot be read")
    return samples


@query(
    "j9_files_in_comments",
    """SELECT concat('smp', o_orderkey) AS sample_name, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS price,
              CASE WHEN o_orderkey % 3 <> 0 THEN 'usd' END AS unit, 'M1' AS mission, 'desk, second desk' AS contact,
              CASE WHEN o_orderkey % 4 <> 0 THEN concat('bill', o_orderkey % 8, '.csv , none') END AS bill,
              concat('ISA.zip', CASE WHEN o_orderkey % 4 <> 0 THEN concat(',bill', o_orderkey % 8, '.csv') ELSE '' END,
                     ',report.pdf', CASE WHEN o_orderstatus = 'F' THEN ',scan.png' ELSE '' END) AS files FROM orders""",
)
def j9_comments(spark, sf_dir):
    """Files that comments below values and records name belong to the sample; lists of a tab name none."""
    listed = F.array_sort(F.transform("files", lambda f: f.getField("filename")))
    price = ["study", "characteristics", "price"]
    return _commented(spark, sf_dir).select(
        "sample_name",
        documents.value_at(price).alias("price"),
        documents.value_at([*price, "unit"]).alias("unit"),
        documents.value_at(["investigation", "study", "comment", "Mission tag"]).alias("mission"),
        documents.value_at(["investigation", "investigation", "comment", "Contact"]).alias("contact"),
        documents.value_at([*price, "comment", "Bill"]).alias("bill"),
        F.array_join(listed, ",").alias("files"),
    )


@query(
    "h4_nested_documents",
    """SELECT o_orderkey AS row_id, p AS path, v AS value FROM (
           SELECT o_orderkey, unnest([
               struct_pack(p := 'characteristics/price/', v := CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)),
               struct_pack(p := 'characteristics/price/unit', v := CASE WHEN o_orderkey % 4 <> 0 THEN 'usd' END),
               struct_pack(p := 'parameter value/status/', v := o_orderstatus),
               struct_pack(p := 'parameter value/status/protocol ref',
                           v := CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END)], recursive := true) FROM orders)
       WHERE v IS NOT NULL""",
)
def h4_nested(spark, sf_dir):
    """Documents of tab rows, exploded to their texts; fields without a subfield are lists."""
    headers, lines = fx.cells(spark, sf_dir)
    rows = isa.with_row_documents(isa.tab_rows(lines), isa.layouts(headers))
    found = documents.leaves(rows.select((F.col("line_no") - 1).alias("row_id"), "document"), ["row_id"])
    return found.select("row_id", F.array_join("path", "/").alias("path"), "value")


@query(
    "h5_leaf_elements",
    r"""SELECT DISTINCT c_custkey, e AS element FROM (
        SELECT c_custkey, unnest(string_split_regex(v, '\s*,\s')) AS e FROM (
            SELECT c_custkey, concat(c_name, ' , ', c_mktsegment, ', a,b') AS v FROM customer
            UNION ALL SELECT c_custkey, c_mktsegment FROM customer))""",
)
def h5(spark, sf_dir):
    listed = F.concat("c_name", F.lit(" , "), "c_mktsegment", F.lit(", a,b"))
    attrs = F.create_map(F.lit("assay.raw data file"), listed, F.lit("study.segment"), F.col("c_mktsegment"))
    customers = fx.table(spark, sf_dir, "customer")
    return customers.select("c_custkey", F.explode(shape.leaf_elements(attrs)).alias("element"))


@query(
    "h6_material_type",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'liver'
              WHEN 4 THEN c_mktsegment END AS material,
              CASE c_custkey % 5 WHEN 0 THEN c_mktsegment WHEN 1 THEN c_mktsegment
              WHEN 4 THEN c_mktsegment END AS legacy FROM customer""",
)
def h6(spark, sf_dir):
    """Legacy only; both; legacy blank; neither; current one blank."""
    case = F.col("c_custkey") % 5
    old = F.when(case == 2, "  ").when(case != 3, F.col("c_mktsegment"))
    new = F.when(case == 1, "liver").when(case == 4, " ")
    both = F.create_map(F.lit(shape.LEGACY), old, F.lit(shape.MATERIAL), new)
    present = F.map_filter(both, lambda _, v: v.isNotNull())
    rows = fx.table(spark, sf_dir, "customer").select("c_custkey", shape.move_material_type(present).alias("m"))
    return rows.select(
        "c_custkey",
        F.col("m")[shape.MATERIAL].alias("material"),
        F.col("m")[shape.LEGACY].alias("legacy"),
    )


@query(
    "h7_bad_names",
    """SELECT p_partkey, CASE p_partkey % 10 WHEN 0 THEN concat(p_name, '/x') ELSE concat('$', p_name) END
              AS assay_name FROM part WHERE p_partkey % 10 < 2""",
)
def h7(spark, sf_dir):
    key = F.col("p_partkey") % 10
    name = (
        F.when(key == 0, F.concat("p_name", F.lit("/x")))
        .when(key == 1, F.concat(F.lit("$"), "p_name"))
        .otherwise(F.col("p_name"))
    )
    rows = fx.table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_brand").alias("accession"), name.alias("assay_name")
    )
    return shape.bad_names(rows).select("p_partkey", "assay_name")


_ASSAY_OF = "CASE WHEN c_custkey % 2 = 0 THEN 'rna' ELSE 'array' END"


@query(
    "h8_assemble_samples",
    f"""SELECT n.accession, {_ASSAY_OF.replace('c_custkey', 'n.c_custkey')} AS assay_name,
               n.column_name AS sample_name,
               CASE WHEN m.sample_name IS NOT NULL THEN concat('study_', n.accession) END AS study_name,
               m.sample_name AS study_sample,
               CASE WHEN n.c_custkey % 2 = 0 THEN 'RNA Sequencing (RNA-Seq)' END AS technology,
               c.c_mktsegment AS segment,
               CASE WHEN m.sample_name IS NOT NULL THEN concat('Title of ', n.accession) END AS title,
               CAST(n.c_custkey AS VARCHAR) AS own
        FROM fx_names n
        LEFT JOIN fx_matched m ON n.accession = m.accession AND n.column_name = m.column_name
        LEFT JOIN customer c ON replace(c.c_name, '#', '-') = m.sample_name""",
)
def h8(spark, sf_dir):
    pairs = fx.names(spark, sf_dir).join(
        fx.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey"
    )

    def one(path, value):
        return F.create_map(F.lit(path), value)

    assays = pairs.select(
        "accession",
        F.when(F.col("c_custkey") % 2 == 0, "rna").otherwise("array").alias("assay_name"),
        F.col("column_name").alias("sample_name"),
        one("assay.parameter value.own", F.col("c_custkey").cast("string")).alias("attrs"),
    )
    study = F.concat(F.lit("study_"), "accession")
    studies = pairs.select(
        "accession",
        study.alias("study_name"),
        "sample_name",
        one("study.characteristics.segment", F.col("c_mktsegment")).alias("attrs"),
    )
    accessions = pairs.select("accession").distinct()
    study_assays = accessions.select(
        "accession",
        F.lit("rna").alias("assay_name"),
        one(fx.TECHNOLOGY, F.lit("RNA Sequencing (RNA-Seq)")).alias("attrs"),
    )
    records = accessions.select(
        "accession",
        study.alias("study_name"),
        one("investigation.study.study title", F.concat(F.lit("Title of "), "accession")).alias("attrs"),
    )
    attrs = F.col("attrs")
    return shape.assemble(assays, studies, study_assays, records).select(
        "accession",
        "assay_name",
        "sample_name",
        "study_name",
        "study_sample",
        attrs[fx.TECHNOLOGY].alias("technology"),
        attrs["study.characteristics.segment"].alias("segment"),
        attrs["investigation.study.study title"].alias("title"),
        attrs["assay.parameter value.own"].alias("own"),
    )


# --- scalar functions ------------------------------------------------------------------


@query(
    "x1_percent_encoding",
    """SELECT page_id, replace(replace(url_encode(url), '%20', ' '), '%2F', '/') AS encoded,
              url AS decoded FROM pages""",
)
def x1(spark, sf_dir):
    encoded = text.percent_encode(F.col("url"))
    return fx.table(spark, sf_dir, "pages").select(
        "page_id", encoded.alias("encoded"), text.percent_decode(encoded).alias("decoded")
    )


def _archive(key: int) -> bytes:
    """An archive that is sound, or broken in one of four ways, as its number says."""
    investigation = _INVESTIGATION
    study = f"Source Name\tSample Name\tCharacteristics[Age]\nm\ts{key}\t{key}\n"
    if key % 6 == 2:
        study = study.replace("\tm\t", "\t").replace("m\t", '"m\t')
    if key % 6 == 3:
        study = f"Source Name\tCharacteristics[Age]\nm\t{key}\n"
    if key % 6 == 4:
        investigation = investigation.replace("Prices", '"Prices of "all" orders"')
    if key % 6 == 5:
        study = study.replace("m\t", "m" * 200_000 + "\t")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("i_x.txt", investigation)
        z.writestr("s_first.txt", study)
        z.writestr("a_first.txt", f"Sample Name\tParameter Value[Reads]\ns{key}\t{key}\n")
    return out.getvalue()[: 100 if key % 6 == 1 else None]


def _archives_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # some archives are large: a few are held at a time
        for at in range(0, len(batch), 50):
            some = batch.iloc[at : at + 50]
            yield pd.DataFrame({"accession": some["accession"], "content": [_archive(k) for k in some["key"]]})


def ingest_datasets(keys):
    """Samples and failures of the datasets with the given (accession, key)."""
    archives = keys.mapInPandas(_archives_of, "accession string, content binary")
    files = keys.select(
        "accession", F.lit("x.zip").alias("filename"), F.lit("isa").alias("datatype"),
        F.lit(True).alias("internal"), F.lit(None).cast("string").alias("condition"),
    )
    return ingest(archives, files)


@query(
    "ingest_failures",
    """SELECT concat('GLDS-', CAST(s_suppkey AS VARCHAR)) AS accession,
              CASE s_suppkey % 6 WHEN 1 THEN 'archive cannot be unpacked'
                   WHEN 2 THEN 'quotes of a tab do not add up' WHEN 3 THEN 'a tab has no Sample Name column'
                   ELSE 'sound' END AS outcome FROM supplier""",
)
def ingest_failures(spark, sf_dir):
    """A dataset per supplier, half of them broken: the others are read whole."""
    keys = fx.table(spark, sf_dir, "supplier").select(
        fx.numbered("GLDS-", F.col("s_suppkey")).alias("accession"), F.col("s_suppkey").cast("bigint").alias("key")
    )
    samples, failures = ingest_datasets(keys)
    sound = samples.select("accession", F.lit("sound").alias("outcome"))
    return sound.unionByName(failures.withColumnRenamed("reason", "outcome"))


@query(
    "x2_regular_expressions",
    r"""SELECT page_id, regexp_matches(url, '^https://[^/]+\.org/') AS chosen,
               regexp_replace(url, '[._-]', '.', 'g') AS dotted_url,
               regexp_replace(url || ' x', '\s', '_', 'g') AS class_label FROM pages""",
)
def x2(spark, sf_dir):
    """Search, replacement and labels by regular expression, as filters and writers use them."""
    url = F.col("url")
    pages = fx.table(spark, sf_dir, "pages")
    chosen = matches("study.characteristics.url", r"^https://[^/]+\.org/").condition()
    return pages.withColumn(
        "attrs", F.map_from_arrays(F.array(F.lit("study.characteristics.url")), F.array(url))
    ).select(
        "page_id",
        chosen.alias("chosen"),
        text.dotted(url).alias("dotted_url"),
        text.label(F.concat(url, F.lit(" x"))).alias("class_label"),
    )


@query(
    "x3_split_with_limit",
    """SELECT page_id, split_part(url, '/', 1) AS a, split_part(url, '/', 2) AS b,
              array_to_string(string_split(url, '/')[3:], '/') AS rest FROM pages""",
)
def x3(spark, sf_dir):
    parts = text.split_id(F.col("url"))
    return fx.table(spark, sf_dir, "pages").select(
        "page_id", parts[0].alias("a"), parts[1].alias("b"), parts[2].alias("rest")
    )


@query(
    "x4_capitalised",
    """SELECT p_partkey, concat(upper(substr(p_name, 1, 1)), lower(substr(p_name, 2))) AS capital,
              lower(p_type) AS low, rtrim(concat(p_name, '  ')) AS stripped FROM part""",
)
def x4(spark, sf_dir):
    return fx.table(spark, sf_dir, "part").select(
        "p_partkey",
        text.capitalised(F.col("p_name")).alias("capital"),
        F.lower("p_type").alias("low"),
        F.rtrim(F.concat("p_name", F.lit("  "))).alias("stripped"),
    )


@query(
    "x5_dotted_names",
    r"""SELECT page_id, regexp_replace(url, '[._-]', '.', 'g') AS dotted,
               starts_with(url, 'https') AS secure FROM pages""",
)
def x5(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select(
        "page_id", text.dotted(F.col("url")).alias("dotted"), F.col("url").startswith("https").alias("secure")
    )


@query(
    "x6_labels",
    r"SELECT doc_id, regexp_replace(text, '[ \t\n\x0B\f\r]', '_', 'g') AS label FROM documents",
)
def x6(spark, sf_dir):
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.label(F.col("text")).alias("label"))


@query(
    "x7_safe_numbers",
    """SELECT o_orderkey, try_cast(CASE o_orderkey % 3 WHEN 0 THEN CAST(o_totalprice AS VARCHAR)
              WHEN 1 THEN o_orderpriority ELSE '1e3' END AS DOUBLE) AS number FROM orders""",
)
def x7(spark, sf_dir):
    key = F.col("o_orderkey") % 3
    mixed = (
        F.when(key == 0, F.col("o_totalprice").cast("string"))
        .when(key == 1, F.col("o_orderpriority"))
        .otherwise("1e3")
    )
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", text.number(mixed).alias("number"))


@query(
    "x8_epoch_seconds",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(epoch(o_orderdate) AS BIGINT)
              ELSE -1 END AS ts FROM orders""",
)
def x8(spark, sf_dir):
    when = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", text.epoch_seconds(when.otherwise("soon")).alias("ts")
    )


@query(
    "x9_row_fingerprints",
    """SELECT o_orderkey, sha256(concat('{"o_custkey":', o_custkey, ',"o_orderstatus":"', o_orderstatus, '"}'))
              AS digest FROM orders""",
)
def x9(spark, sf_dir):
    from assaylens.functions.digest import row_digest

    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", row_digest(F.col("o_custkey"), F.col("o_orderstatus")).alias("digest")
    )


@query(
    "x10_numeric_functions",
    """SELECT l_returnflag, l_linestatus, round(avg(ln(l_quantity + 1)), 6) AS mean_log,
              round(avg(log10(l_quantity)), 6) AS mean_log10, max(abs(l_quantity - 25)) AS magnitude
       FROM lineitem GROUP BY 1, 2""",
)
def x10(spark, sf_dir):
    """Logarithms and magnitudes, as the analyses compute them."""
    kinds = ["l_returnflag", "l_linestatus"]
    items = fx.table(spark, sf_dir, "lineitem").select(*kinds, F.col("l_quantity").alias("value"))

    def mean(df, name):
        return df.groupBy(*kinds).agg(F.round(F.avg("value"), 6).alias(name))

    centred = items.withColumn("value", F.col("value") - 25)
    largest = centred.groupBy(*kinds).agg(analytics.magnitude("value").alias("magnitude"))
    logs = mean(analytics.log_value(items, 1.0), "mean_log")
    return logs.join(mean(analytics.log_value(items, 0.0, 10), "mean_log10"), kinds).join(largest, kinds)
