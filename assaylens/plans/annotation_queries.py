"""Registered queries on sample annotation: filters, views, facets, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylens.operators import files as file_ops
from assaylens.operators import predicates as p
from assaylens.operators import views
from assaylens.operators.order import natural_order
from assaylens.operators.ranking import with_position
from assaylens.plans import fixtures as fx
from assaylens.plans.registry import query

IDS = ["accession", "assay_name", "sample_name"]
ID_SQL = "accession, assay_name, sample_name"


def _chosen(spark, sf_dir, *predicates):
    return p.filter_samples(fx.samples(spark, sf_dir), predicates).select(*IDS)


@query(
    "p1_field_equals",
    f"SELECT {ID_SQL} FROM fx_samples WHERE nation IN ('NATION_3', 'NATION_7', 'NATION_12')",
)
def p1(spark, sf_dir):
    return _chosen(spark, sf_dir, p.eq(fx.NATION, "NATION_3|NATION_7|NATION_12"))


@query(
    "p2_field_matches",
    f"SELECT {ID_SQL} FROM fx_samples WHERE regexp_matches(nation, '_1[0-9]$')",
)
def p2(spark, sf_dir):
    return _chosen(spark, sf_dir, p.matches(fx.NATION, "_1[0-9]$"))


@query("p3_field_exists", f"SELECT {ID_SQL} FROM fx_samples WHERE tier IS NOT NULL")
def p3(spark, sf_dir):
    return _chosen(spark, sf_dir, p.exists(fx.TIER))


@query("p4_any_field_exists", f"SELECT {ID_SQL} FROM fx_samples WHERE tier IS NOT NULL")
def p4(spark, sf_dir):
    return _chosen(spark, sf_dir, p.any_exists("study.factor value", ["tier", "dose"]))


@query("p5_block_exists", f"SELECT {ID_SQL} FROM fx_samples WHERE tier IS NOT NULL")
def p5(spark, sf_dir):
    return _chosen(spark, sf_dir, p.block_exists("study.factor value"))


@query(
    "p6_mixed_ids",
    f"""SELECT {ID_SQL} FROM fx_samples WHERE accession = 'GLDS-2'
        OR (accession = 'GLDS-3' AND assay_name = 'building')
        OR (accession = 'GLDS-1' AND assay_name = 'machinery'
            AND sample_name = 'Customer#000000003')""",
)
def p6(spark, sf_dir):
    ids = "GLDS-2|GLDS-3/building|GLDS-1/machinery/Customer#000000003"
    return _chosen(spark, sf_dir, p.by_id(ids))


@query(
    "p6_many_ids",
    f"""SELECT {ID_SQL} FROM fx_samples
        WHERE (CAST(replace(sample_name, 'Customer#', '') AS BIGINT) <= 300 AND assay_name = 'building')
           OR accession = 'GLDS-5'""",
)
def p6_many(spark, sf_dir):
    """Hundreds of ids, and samples without a name among the rows."""
    df = fx.samples(spark, sf_dir)
    nameless = df.withColumn("sample_name", F.lit(None).cast("string")).withColumn("accession", F.lit("GLDS-9"))
    ids = [f"GLDS-{a}/building/Customer#{k:09d}" for a in range(1, 6) for k in range(1, 301)]
    found = p.filter_samples(df.unionByName(nameless), [p.by_id("GLDS-5", *ids)])
    return found.select(*IDS)


@query(
    "p7_conjunction",
    f"""SELECT {ID_SQL} FROM fx_samples WHERE tier IN ('high', 'low') AND tier IS NOT NULL
        AND regexp_matches(nation, '[02468]$') AND accession = 'GLDS-4'""",
)
def p7(spark, sf_dir):
    return _chosen(
        spark,
        sf_dir,
        p.isin(fx.TIER, ["high", "low"]),
        p.exists(fx.TIER),
        p.matches(fx.NATION, "[02468]$"),
        p.eq("id.accession", "GLDS-4"),
    )


@query(
    "p8_file_predicates",
    f"""SELECT {ID_SQL}, filename, datatype FROM fx_sample_files
        WHERE datatype IN ('normalized counts', 'raw reads') AND tier = 'high'
        AND regexp_matches(filename, 'GLDS-[135]_')""",
)
def p8(spark, sf_dir):
    found = p.filter_samples(
        fx.samples_with_files(spark, sf_dir),
        [
            p.isin("file.datatype", ["normalized counts", "raw reads"]),
            p.matches("file.filename", "GLDS-[135]_"),
            p.eq(fx.TIER, "high"),
        ],
    )
    return found.select(
        *IDS, F.col("file.filename").alias("filename"), F.col("file.datatype").alias("datatype")
    )


@query(
    "r1_projection",
    f"""SELECT {ID_SQL}, CAST(2 + CASE WHEN tier IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_fields,
        concat(balance_text, '/', nation) AS characteristics, tier FROM fx_samples""",
)
def r1(spark, sf_dir):
    # the block absorbs the single field below it
    paths = views.reduce_paths([fx.NATION, "study.characteristics", fx.TIER])
    kept = views.project(fx.samples(spark, sf_dir), paths)
    attrs = F.col("attrs")
    return kept.select(
        *IDS,
        F.size("attrs").cast("bigint").alias("n_fields"),
        F.concat_ws("/", attrs[fx.BALANCE], attrs[fx.NATION]).alias("characteristics"),
        attrs[fx.TIER].alias("tier"),
    )


@query("r2_unnest_files", f"SELECT {ID_SQL}, filename, datatype FROM fx_sample_files")
def r2(spark, sf_dir):
    rows = p.unnest_files(fx.samples_with_files(spark, sf_dir))
    return rows.select(
        *IDS, F.col("file.filename").alias("filename"), F.col("file.datatype").alias("datatype")
    )


def _short_names(df):
    """Last segment of dotted column names, with underscores."""
    return df.toDF(*[c.split(".")[-1].replace(" ", "_") for c in df.columns])


@query(
    "r3_samples_view",
    f"""SELECT {ID_SQL}, study_name, balance_text AS balance, nation, tier FROM fx_samples
        WHERE tier IS NOT NULL AND nation <> 'NATION_0'""",
)
def r3(spark, sf_dir):
    table = views.samples_view(
        fx.samples(spark, sf_dir),
        p.exists(fx.TIER),
        p.matches(fx.NATION, "_([1-9]|..)$"),
        fields=["study.characteristics"],
    )
    return _short_names(table)


_SAMPLE_NATKEY = """list_transform(regexp_extract_all({c}, '([0-9]+|[^0-9]+)', 1),
    lambda r: CASE WHEN regexp_matches(r, '^[0-9]')
              THEN concat(lpad(CAST(length(ltrim(r, '0')) AS VARCHAR), 8, '0'), ltrim(r, '0'))
              ELSE lower(r) END)"""


def natkey_sql(column: str) -> str:
    return _SAMPLE_NATKEY.format(c=column)


@query(
    "a1_file_descriptors",
    """SELECT accession, assay_name, technology, filename, datatype,
              count(*) OVER g AS n_values, row_number() OVER (g ORDER BY sample_name) - 1 AS position, sample_name
       FROM fx_sample_files WHERE datatype IS NOT NULL
       WINDOW g AS (PARTITION BY accession, assay_name, technology, filename, datatype)""",
)
def a1(spark, sf_dir):
    chosen = p.filter_samples(fx.samples_with_files(spark, sf_dir), [p.exists("file.datatype")])
    return file_ops.file_descriptors(chosen)


@query(
    "a2_assays_view",
    """SELECT accession, assay_name, true AS balance, true AS nation,
              bool_or(tier IS NOT NULL) AS tier, true AS segment, false AS dose
       FROM fx_samples GROUP BY 1, 2""",
)
def a2(spark, sf_dir):
    table = views.assays_view(
        fx.samples(spark, sf_dir),
        fields=["study.characteristics", fx.TIER, fx.SEGMENT, "study.factor value.dose"],
    )
    return _short_names(table)


@query("a5_shape", "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(6 AS BIGINT) AS n_columns FROM fx_joined")
def a5(spark, sf_dir):
    from assaylens.operators import profile, tables

    joined = tables.outer_join([fx.wide(spark, sf_dir, 1), fx.wide(spark, sf_dir, 2)], "feature")
    return profile.shape(joined, ["feature"])


_FACETS = """
SELECT DISTINCT * FROM (
    SELECT 'study' AS category, 'characteristics' AS subfield, 'nation' AS key, nation AS value FROM fx_samples
    UNION ALL SELECT 'study', 'characteristics', 'balance', balance_text FROM fx_samples
    UNION ALL SELECT 'study', 'factor value', 'tier', tier FROM fx_samples WHERE tier IS NOT NULL
    UNION ALL SELECT 'assay', 'parameter value', 'segment', segment FROM fx_samples
    UNION ALL SELECT 'investigation', 'study assays', 'study assay technology type', technology FROM fx_samples)
"""  # noqa: E501


@query("a6_facets", _FACETS)
def a6(spark, sf_dir):
    return views.facet_values(fx.samples(spark, sf_dir))


@query(
    "a6_facet_lists",
    f"""SELECT category, subfield, key, count(*) OVER g AS n_values,
               row_number() OVER (g ORDER BY value) - 1 AS position, value
        FROM ({_FACETS}) WINDOW g AS (PARTITION BY category, subfield, key)""",
)
def a6_lists(spark, sf_dir):
    return views.facet_lists(fx.samples(spark, sf_dir))


@query("a7_facet_keys", f"SELECT DISTINCT category, subfield, key FROM ({_FACETS})")
def a7(spark, sf_dir):
    return views.facet_keys(fx.samples(spark, sf_dir))


@query("a7_facet_blocks", f"SELECT DISTINCT category, subfield FROM ({_FACETS})")
def a7_blocks(spark, sf_dir):
    return views.facet_blocks(fx.samples(spark, sf_dir))


@query(
    "a8_assays_by_accession",
    f"""SELECT accession, assay_name, CAST(row_number() OVER (PARTITION BY accession
               ORDER BY {natkey_sql('assay_name')}, assay_name) - 1 AS BIGINT) AS place
        FROM (SELECT DISTINCT accession, assay_name FROM fx_samples)""",
)
def a8(spark, sf_dir):
    pairs = views.assays_by_accession(fx.samples(spark, sf_dir))
    return with_position(pairs, natural_order(["assay_name"]), ["accession"], "place")


@query("a9_datatypes", "SELECT DISTINCT datatype FROM fx_sample_files WHERE datatype IS NOT NULL")
def a9(spark, sf_dir):
    return views.datatypes(fx.samples_with_files(spark, sf_dir))


@query(
    "a10_carried_sets",
    """SELECT DISTINCT 'accession' AS kind, accession AS value FROM fx_sample_files
       UNION ALL SELECT DISTINCT 'datatype', datatype FROM fx_sample_files
       UNION ALL SELECT DISTINCT 'gct_valid', CASE WHEN gct_valid THEN 'true' END FROM fx_sample_files""",
)
def a10(spark, sf_dir):
    files = p.unnest_files(fx.samples_with_files(spark, sf_dir))
    return views.carried_sets(files.select("accession", "file.datatype", "file.gct_valid"))


@query(
    "a11_samples_per_accession",
    "SELECT accession, CAST(count(*) AS BIGINT) AS n_samples FROM fx_samples GROUP BY 1",
)
def a11(spark, sf_dir):
    return views.samples_per_accession(fx.samples(spark, sf_dir))


@query(
    "j9_attach_files",
    f"""SELECT {ID_SQL}, filename FROM (
        SELECT s.{ID_SQL.replace(', ', ', s.')}, f.filename, s.technology, f.datatype,
               coalesce(f.internal, false) AS internal,
               regexp_matches(f.filename, concat('seq_', s.assay_name)) AS mentioned
        FROM fx_samples s JOIN (
            SELECT accession, filename, datatype, internal FROM fx_typed
            UNION ALL SELECT DISTINCT accession, concat(accession, '_rna_seq_', assay_name, '.bam'),
                   'alignment', NULL FROM fx_samples
            UNION ALL SELECT DISTINCT accession, concat(accession, '_rna_seq_visualization_PCA_table.csv'),
                   'pca', true FROM fx_samples) f ON s.accession = f.accession)
        WHERE (internal OR mentioned)
          AND (datatype <> 'pca' OR technology = 'RNA Sequencing (RNA-Seq)')""",
)
def j9(spark, sf_dir):
    """Alignment files are named in the annotation; archives and PCA tables are internal."""
    from assaylens.operators.shape import leaf_elements
    from assaylens.sources.listing import typed_files

    samples = fx.samples(spark, sf_dir)
    named = F.concat(F.col("accession"), F.lit("_rna_seq_"), F.col("assay_name"), F.lit(".bam"))
    annotated = samples.withColumn(
        "attrs",
        F.map_concat(
            "attrs", F.create_map(F.lit("assay.parameter value.files"), F.concat(named, F.lit(" , none")))
        ),
    )
    pca = F.concat(F.col("accession"), F.lit("_rna_seq_visualization_PCA_table.csv"))
    extra = samples.select("accession", named.alias("filename")).distinct().unionByName(
        samples.select("accession", pca.alias("filename")).distinct()
    )
    files = fx.typed(spark, sf_dir).select("accession", "filename", "condition", "internal")
    both = files.unionByName(
        typed_files(extra).select("accession", "filename", "condition", "internal")
    )
    return file_ops.attach_files(annotated.withColumn("elements", leaf_elements(F.col("attrs"))), both)


@query(
    "j10_samples_of_files",
    "SELECT DISTINCT accession, assay_name, filename, sample_name FROM fx_sample_files",
)
def j10(spark, sf_dir):
    return file_ops.files_with_samples(fx.samples_with_files(spark, sf_dir))


@query(
    "o1_natural_order",
    f"""SELECT {ID_SQL}, CAST(row_number() OVER (ORDER BY {natkey_sql('accession')},
               {natkey_sql('assay_name')}, {natkey_sql('sample_name')}) - 1 AS BIGINT) AS pos
        FROM fx_samples""",
)
def o1(spark, sf_dir):
    return with_position(fx.samples(spark, sf_dir).select(*IDS), natural_order(IDS))


_COLLATED = r"""icu_sort_key(coalesce(array_to_string(list_transform(regexp_extract_all(token, '[0-9]+|[^0-9]+'),
    lambda r: CASE WHEN r[1] BETWEEN '0' AND '9'
              THEN concat(lpad(CAST(length(ltrim(r, '0')) AS VARCHAR), 8, '0'), ltrim(r, '0')) ELSE r END), ''), ''), 'en_US')"""


@query(
    "o1_collated_order",
    f"""SELECT token, CAST(row_number() OVER (ORDER BY {_COLLATED}, token) - 1 AS BIGINT) AS pos
        FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '[ \n]+')) AS token FROM documents)""",
)
def o1_collated(spark, sf_dir):
    """All different words of the documents, accents and punctuation included, in a reader's order."""
    tokens = fx.table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("token"))
    return with_position(tokens.distinct(), natural_order(["token"], collated=True))


@query(
    "o2_multi_column_order",
    f"""SELECT sample_name, tier, balance, CAST(row_number() OVER (ORDER BY
               {natkey_sql('tier')} ASC NULLS FIRST, {natkey_sql('CAST(balance AS VARCHAR)')} DESC NULLS LAST,
               {natkey_sql('sample_name')} ASC NULLS FIRST) - 1 AS BIGINT) AS pos
        FROM fx_samples""",
)
def o2(spark, sf_dir):
    samples = fx.samples(spark, sf_dir).select(
        "sample_name",
        F.col("attrs")[fx.TIER].alias("tier"),
        F.split(F.col("attrs")[fx.BALANCE], " ")[0].cast("bigint").alias("balance"),
    )
    order = natural_order(["tier", "balance", "sample_name"], [True, False, True])
    return with_position(samples, order)
