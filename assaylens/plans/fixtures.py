"""The data model of this package, derived from the TPC-H-like tables.

Each fixture is a DataFrame builder and the SQL of the same rows; ``SQL`` holds
the latter, by name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylens.functions.text import as_utc, with_unit
from assaylens.operators.files import TECHNOLOGY
from assaylens.operators.shape import drop_empty
from assaylens.sources import listing as listing_source

NATION = "study.characteristics.nation"
BALANCE = "study.characteristics.balance"
TIER = "study.factor value.tier"
SEGMENT = "assay.parameter value.segment"

SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


# --- samples --------------------------------------------------------------------------

SQL["fx_samples"] = """
SELECT concat('GLDS-', CAST(r_regionkey + 1 AS VARCHAR)) AS accession,
       lower(c_mktsegment) AS assay_name, c_name AS sample_name,
       concat('study_', lower(n_name)) AS study_name, n_name AS nation,
       CASE WHEN c_acctbal >= 5000 THEN 'high' WHEN c_acctbal >= 0 THEN 'low' END AS tier,
       CAST(floor(c_acctbal) AS BIGINT) AS balance,
       concat(CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR), ' {usd}') AS balance_text,
       CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING') THEN 'RNA Sequencing (RNA-Seq)'
            ELSE 'DNA Microarray' END AS technology,
       c_mktsegment AS segment
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


def annotated(values: dict[str, Column]) -> Column:
    """Annotation map without empty values."""
    entries = [x for path, value in values.items() for x in (F.lit(path), value)]
    return drop_empty(F.create_map(*entries))


def tier(balance: Column) -> Column:
    return F.when(balance >= 5000, "high").when(balance >= 0, "low")


def technology_of(segment: Column) -> Column:
    return F.when(segment.isin("AUTOMOBILE", "BUILDING"), "RNA Sequencing (RNA-Seq)").otherwise(
        "DNA Microarray"
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample rows: one per customer; a fifth of the regions is one accession."""
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    joined = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    )
    balance = F.floor("c_acctbal").cast("bigint").cast("string")
    attrs = annotated(
        {
            NATION: F.col("n_name"),
            TIER: tier(F.col("c_acctbal")),
            BALANCE: with_unit(balance, F.lit("usd")),
            SEGMENT: F.col("c_mktsegment"),
            TECHNOLOGY: technology_of(F.col("c_mktsegment")),
        }
    )
    return joined.select(
        numbered("GLDS-", F.col("r_regionkey") + 1).alias("accession"),
        F.lower("c_mktsegment").alias("assay_name"),
        F.col("c_name").alias("sample_name"),
        F.concat(F.lit("study_"), F.lower("n_name")).alias("study_name"),
        attrs.alias("attrs"),
    )


# --- files ----------------------------------------------------------------------------

SUFFIXES = (
    "_rna_seq_Normalized_Counts.csv",
    "_rna_seq_Unnormalized_Counts.csv",
    "_array_differential_expression.csv",
    "_sample_raw.fastq.gz",
    "_metadata_x.zip",
)
OTHER_SUFFIX = "_notes.docx"

_SUFFIX_SQL = " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(SUFFIXES))

SQL["fx_listing"] = f"""
SELECT concat('GLDS-', CAST(o_custkey % 5 + 1 AS VARCHAR)) AS accession,
       concat('GLDS-', CAST(o_custkey % 5 + 1 AS VARCHAR),
              CASE o_orderkey % 6 {_SUFFIX_SQL} ELSE '{OTHER_SUFFIX}' END) AS filename,
       CAST(o_orderkey AS BIGINT) AS version,
       CASE WHEN o_orderkey % 4 = 0 THEN 'unknown'
            ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS date_modified,
       CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE '1997-06-01 12:00:00' END AS date_created
FROM orders
"""
SQL["fx_stamped"] = """
SELECT *, greatest(
    coalesce(CAST(epoch(try_cast(date_modified AS TIMESTAMP)) AS BIGINT), -1),
    coalesce(CAST(epoch(try_cast(date_created AS TIMESTAMP)) AS BIGINT), -1)) AS ts
FROM fx_listing
"""
SQL["fx_latest"] = """
SELECT accession, filename, version, ts FROM (
    SELECT *, row_number() OVER (PARTITION BY accession, filename
                                 ORDER BY ts DESC, version DESC) AS k FROM fx_stamped)
WHERE k = 1
"""
SQL["fx_typed"] = """
SELECT *,
    CASE WHEN filename LIKE '%Normalized_Counts.csv' THEN 'normalized counts'
         WHEN filename LIKE '%Unnormalized_Counts.csv' THEN 'unnormalized counts'
         WHEN filename LIKE '%differential_expression.csv' THEN 'differential expression'
         WHEN filename LIKE '%_raw.fastq.gz' THEN 'raw reads'
         WHEN filename LIKE '%_metadata_x.zip' THEN 'isa' END AS datatype,
    CASE WHEN filename LIKE '%.csv' THEN 'table' END AS type,
    CASE WHEN filename LIKE '%Unnormalized_Counts.csv' THEN true END AS joinable,
    CASE WHEN filename LIKE '%ormalized_Counts.csv' THEN true END AS gct_valid,
    CASE WHEN filename LIKE '%_metadata_x.zip' THEN true END AS internal
FROM fx_latest
"""
# every sample of a dataset has all files of the dataset
SQL["fx_sample_files"] = """
SELECT s.*, f.filename, f.datatype, f.gct_valid
FROM fx_samples s JOIN fx_typed f ON s.accession = f.accession
"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listing with many versions per name, and times that are no times."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    accession = numbered("GLDS-", F.col("o_custkey") % 5 + 1)
    suffix = F.lit(OTHER_SUFFIX)
    for i, text in enumerate(SUFFIXES):
        suffix = F.when(key % 6 == i, text).otherwise(suffix)
    modified = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return orders.select(
        accession.alias("accession"),
        F.concat(accession, suffix).alias("filename"),
        key.cast("bigint").alias("version"),
        F.when(key % 4 == 0, "unknown").otherwise(modified).alias("date_modified"),
        F.when(key % 8 != 0, "1997-06-01 12:00:00").alias("date_created"),
    )


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = listing_source.with_timestamp(listing(spark, sf_dir))
    return listing_source.latest_files(stamped.select("accession", "filename", "version", "ts"))


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing_source.typed_files(latest(spark, sf_dir))


def samples_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample rows with the files of their dataset: at most six names per accession."""
    per_accession = (
        typed(spark, sf_dir)
        .groupBy("accession")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct("filename", "datatype", "type", "joinable", "index_name", "gct_valid")
                )
            ).alias("files")
        )
    )
    return samples(spark, sf_dir).join(per_accession, "accession")


# --- measurements ---------------------------------------------------------------------

SQL["fx_meas"] = """
SELECT concat('GLDS-', CAST(l_linenumber % 3 + 1 AS VARCHAR)) AS accession,
       lower(l_linestatus) AS assay_name, s_name AS sample_name,
       concat('G', CAST(l_partkey AS VARCHAR)) AS feature, sum(l_quantity) AS value
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4
"""
# measurements of pooled samples, one per nation: the wide form has the same columns at any scale
SQL["fx_pooled"] = """
SELECT concat('GLDS-', CAST(l_linenumber % 3 + 1 AS VARCHAR)) AS accession,
       lower(l_linestatus) AS assay_name, n_name AS sample_name,
       concat('G', CAST(l_partkey AS VARCHAR)) AS feature, sum(l_quantity) AS value
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY 1, 2, 3, 4
"""
# annotation of the measured samples
SQL["fx_measured"] = """
SELECT a.accession, b.assay_name, s_name AS sample_name, n_name AS nation, r_name AS region,
       CASE WHEN s_acctbal >= 5000 THEN 'high' WHEN s_acctbal >= 0 THEN 'low' END AS tier
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey,
     (VALUES ('GLDS-1'), ('GLDS-2'), ('GLDS-3')) AS a(accession),
     (VALUES ('o'), ('f')) AS b(assay_name)
"""


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    return _measured(items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")), "s_name")


def pooled_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    joined = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(
        nations, F.col("s_nationkey") == F.col("n_nationkey")
    )
    return _measured(joined, "n_name")


def _measured(rows: DataFrame, sample: str) -> DataFrame:
    return rows.groupBy(
        numbered("GLDS-", F.col("l_linenumber") % 3 + 1).alias("accession"),
        F.lower("l_linestatus").alias("assay_name"),
        F.col(sample).alias("sample_name"),
        numbered("G", F.col("l_partkey")).alias("feature"),
    ).agg(F.sum("l_quantity").alias("value"))


def _measured_ids() -> list[Column]:
    accession = F.explode(F.array(*[F.lit(f"GLDS-{i}") for i in (1, 2, 3)]))
    return [accession.alias("accession")]


def measured_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation of the measured samples: nation, region and tier of the supplier."""
    suppliers = table(spark, sf_dir, "supplier")
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    joined = suppliers.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).join(
        regions, F.col("n_regionkey") == F.col("r_regionkey")
    )
    attrs = annotated(
        {
            NATION: F.col("n_name"),
            "study.characteristics.region": F.col("r_name"),
            TIER: tier(F.col("s_acctbal")),
        }
    )
    rows = joined.select(F.col("s_name").alias("sample_name"), attrs.alias("attrs"), *_measured_ids())
    return rows.withColumn("assay_name", F.explode(F.array(F.lit("o"), F.lit("f"))))


def pooled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation of the pooled samples: the region of the nation."""
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    joined = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    attrs = annotated(
        {
            "study.characteristics.region": F.col("r_name"),
            "study.factor value.number": F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey").cast("string")),
        }
    )
    rows = joined.select(F.col("n_name").alias("sample_name"), attrs.alias("attrs"), *_measured_ids())
    return rows.withColumn("assay_name", F.explode(F.array(F.lit("o"), F.lit("f"))))


# --- wide tables ----------------------------------------------------------------------

for _k in (1, 2):
    SQL[f"fx_wide{_k}"] = f"""
SELECT concat('G', CAST(l_partkey AS VARCHAR)) AS feature,
       sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a{_k},
       sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS n{_k},
       sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r{_k}
FROM lineitem WHERE l_partkey % 3 <> {_k - 1} GROUP BY 1
"""
SQL["fx_joined"] = """
SELECT coalesce(x.feature, y.feature) AS feature, a1, n1, r1, a2, n2, r2
FROM fx_wide1 x FULL JOIN fx_wide2 y ON x.feature = y.feature
"""


def wide(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Wide table: features × return flags. Both have a third of the parts, each another third."""
    chosen = table(spark, sf_dir, "lineitem").filter(F.col("l_partkey") % 3 != k - 1)
    sums = [
        F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity"))).alias(f"{flag.lower()}{k}")
        for flag in "ANR"
    ]
    return chosen.groupBy(numbered("G", F.col("l_partkey")).alias("feature")).agg(*sums)


# --- names ----------------------------------------------------------------------------

SQL["fx_names"] = """
SELECT concat('GLDS-', CAST(c_nationkey + 1 AS VARCHAR)) AS accession, c_custkey,
       replace(c_name, '#', '-') AS sample_name,
       CASE c_custkey % 4 WHEN 0 THEN replace(c_name, '#', '-')
            WHEN 1 THEN replace(c_name, '#', '.')
            WHEN 2 THEN concat(replace(c_name, '#', '_'), '_rep')
            ELSE concat('X', c_name) END AS column_name
FROM customer
"""
SQL["fx_matched"] = r"""
SELECT accession, column_name, sample_name, tier FROM (
    SELECT *, min(tier) OVER (PARTITION BY accession, column_name) AS best FROM (
        SELECT c.accession, c.column_name, s.sample_name,
            CASE WHEN c.column_name = s.sample_name THEN 1
                 WHEN c.d = s.d THEN 2
                 WHEN starts_with(c.d, s.d) OR starts_with(s.d, c.d) THEN 3 END AS tier
        FROM (SELECT *, regexp_replace(column_name, '[._-]', '.', 'g') AS d FROM fx_names) c
        JOIN (SELECT *, regexp_replace(sample_name, '[._-]', '.', 'g') AS d FROM fx_names) s
          ON c.accession = s.accession)
    WHERE tier IS NOT NULL)
WHERE tier = best
"""


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample names and the names data files use: equal, dotted, longer, or unrelated."""
    key, name = F.col("c_custkey"), F.col("c_name")
    other = (
        F.when(key % 4 == 0, F.replace(name, F.lit("#"), F.lit("-")))
        .when(key % 4 == 1, F.replace(name, F.lit("#"), F.lit(".")))
        .when(key % 4 == 2, F.concat(F.replace(name, F.lit("#"), F.lit("_")), F.lit("_rep")))
        .otherwise(F.concat(F.lit("X"), name))
    )
    return table(spark, sf_dir, "customer").select(
        numbered("GLDS-", F.col("c_nationkey") + 1).alias("accession"),
        "c_custkey",
        F.replace(name, F.lit("#"), F.lit("-")).alias("sample_name"),
        other.alias("column_name"),
    )


# --- annotation tabs ------------------------------------------------------------------

SQL["fx_cells"] = """
SELECT o_orderkey AS row_id, pos, header, value FROM (
SELECT o_orderkey, 0 AS pos, 'Source Name' AS header, concat('src', CAST(o_custkey AS VARCHAR)) AS value FROM orders UNION ALL
SELECT o_orderkey, 1, 'Characteristics[Price,http://x/1,EFO]', CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) FROM orders UNION ALL
SELECT o_orderkey, 2, 'Unit', CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'usd' END FROM orders UNION ALL
SELECT o_orderkey, 3, 'Protocol REF', 'P1' FROM orders UNION ALL
SELECT o_orderkey, 4, 'Sample Name', concat('smp', CAST(o_orderkey AS VARCHAR)) FROM orders UNION ALL
SELECT o_orderkey, 5, 'Protocol REF', CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END FROM orders UNION ALL
SELECT o_orderkey, 6, 'Parameter Value[status]', o_orderstatus FROM orders)
"""  # noqa: E501
# main fields with the protocol reference and unit that belong to them
SQL["fx_fields"] = """
SELECT row_id, f.pos AS pos, f.field AS field, f.subfield AS subfield, f.value AS value,
       f.protocol_ref AS protocol_ref, f.unit AS unit
FROM (SELECT o_orderkey AS row_id, unnest([
    {'pos': 0, 'field': 'Source Name', 'subfield': CAST(NULL AS VARCHAR),
     'value': concat('src', CAST(o_custkey AS VARCHAR)),
     'protocol_ref': CAST(NULL AS VARCHAR), 'unit': CAST(NULL AS VARCHAR)},
    {'pos': 1, 'field': 'Characteristics', 'subfield': 'Price',
     'value': CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR),
     'protocol_ref': CAST(NULL AS VARCHAR), 'unit': CASE WHEN o_orderkey % 4 <> 0 THEN 'usd' END},
    {'pos': 4, 'field': 'Sample Name', 'subfield': CAST(NULL AS VARCHAR),
     'value': concat('smp', CAST(o_orderkey AS VARCHAR)),
     'protocol_ref': 'P1', 'unit': CAST(NULL AS VARCHAR)},
    {'pos': 6, 'field': 'Parameter Value', 'subfield': 'status', 'value': o_orderstatus,
     'protocol_ref': CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END, 'unit': CAST(NULL AS VARCHAR)}]) AS f
    FROM orders)
"""


def tab(
    rows: DataFrame, accession: Column, row_id: Column, columns: Sequence[tuple[str, Column]], kind: str = "s"
) -> tuple[DataFrame, DataFrame]:
    """(headers, lines) of one tab per accession; the row number is the id plus one."""
    keys = [accession.alias("accession"), F.lit(kind).alias("kind"), F.lit("tab").alias("tab")]
    header = F.array(*[F.lit(name) for name, _ in columns])
    lines = rows.select(
        *keys,
        (row_id + 1).cast("bigint").alias("line_no"),
        F.array(*[c.cast("string") for _, c in columns]).alias("cells"),
    )
    headers = rows.select(*keys).distinct().withColumn("header", header)
    return headers, lines


def cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(headers, lines) of study tabs with qualifiers and protocol references."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    columns = [
        ("Source Name", numbered("src", F.col("o_custkey"))),
        ("Characteristics[Price,http://x/1,EFO]", F.floor("o_totalprice").cast("bigint")),
        ("Unit", F.when(key % 4 != 0, "usd")),
        ("Protocol REF", F.lit("P1")),
        ("Sample Name", numbered("smp", key)),
        ("Protocol REF", F.when(key % 3 != 0, F.col("o_orderpriority"))),
        ("Parameter Value[status]", F.col("o_orderstatus")),
    ]
    return tab(orders, numbered("GLDS-", F.col("o_custkey") % 5 + 1), key, columns)


# --- refresh --------------------------------------------------------------------------

SQL["fx_cached"] = """
SELECT o_custkey AS accession, count(*) AS n_files, max(o_orderdate) AS ts FROM orders
WHERE o_custkey % 5 <> 0 AND (o_orderdate < TIMESTAMP '2000-01-01 00:00:00' OR o_custkey % 7 = 0) GROUP BY 1
"""
SQL["fx_live"] = """
SELECT o_custkey AS accession, count(*) AS n_files, max(o_orderdate) AS ts FROM orders
WHERE o_custkey % 7 <> 0 OR o_custkey % 5 = 0 GROUP BY 1
"""
SQL["fx_classes"] = """
SELECT coalesce(c.accession, l.accession) AS accession,
       CASE WHEN l.accession IS NULL THEN 'dropped' WHEN c.accession IS NULL THEN 'new'
            WHEN c.n_files = l.n_files AND c.ts = l.ts THEN 'fresh' ELSE 'updated' END AS class
FROM fx_cached c FULL JOIN fx_live l ON c.accession = l.accession
"""


def cached_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was listed at the last refresh: (accession, filename, ts)."""
    old = F.col("o_orderdate") < F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    known = (F.col("o_custkey") % 5 != 0) & (old | (F.col("o_custkey") % 7 == 0))
    return _listed(table(spark, sf_dir, "orders").filter(known))


def live_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is listed now; every order is in one of the listings at least."""
    listed = (F.col("o_custkey") % 7 != 0) | (F.col("o_custkey") % 5 == 0)
    return _listed(table(spark, sf_dir, "orders").filter(listed))


def _listed(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_custkey").cast("string").alias("accession"),
        numbered("file", F.col("o_orderkey")).alias("filename"),
        F.unix_seconds(as_utc(F.col("o_orderdate"))).alias("ts"),
    )


# --- status ---------------------------------------------------------------------------

SQL["fx_status"] = """
SELECT event_id, CAST(user_id AS VARCHAR) AS accession,
       CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'updated'
            WHEN 'purchase' THEN 'dropped' WHEN 'view' THEN 'fresh' ELSE 'warning' END AS status,
       CAST(epoch_us(ts) AS BIGINT) AS report_ts
FROM events
"""


def status_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "error", "failed")
        .when(kind == "signup", "updated")
        .when(kind == "purchase", "dropped")
        .when(kind == "view", "fresh")
        .otherwise("warning")
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("string").alias("accession"),
        status.alias("status"),
        F.unix_micros(as_utc(F.col("ts"))).alias("report_ts"),
    )
