"""Registered queries on data tables: selection, joins, matching, profiles, output."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylens.api import Repository
from assaylens.operators import analytics, names, profile, tables
from assaylens.operators import files as file_ops
from assaylens.operators import predicates as p
from assaylens.plans import fixtures as fx
from assaylens.plans.registry import query
from assaylens.session import scratch_path
from assaylens.sources import store
from assaylens.sources.catalogue import TableStore

SAMPLE = ["accession", "assay_name", "sample_name"]


def _wide(spark, sf_dir):
    return [fx.wide(spark, sf_dir, k) for k in (1, 2)]


def _joined(spark, sf_dir):
    return tables.outer_join(_wide(spark, sf_dir), "feature")


@query(
    "r7_select_columns",
    'SELECT feature, n1 AS "GLDS_1_x_n1", a2 AS "GLDS_2_y_a2", r1 AS "GLDS_1_x_r1" FROM fx_joined',
)
def r7(spark, sf_dir):
    first, second = _wide(spark, sf_dir)
    joined = tables.outer_join(
        [
            tables.qualify(first, "feature", "GLDS-1", "x"),
            tables.qualify(second, "feature", "GLDS-2", "y"),
        ],
        "feature",
    )
    chosen = tables.select_columns(joined, "feature", ["GLDS-1/x/n1", "a2", "r1"])
    return chosen.toDF(*[c.replace("/", "_").replace("-", "_") for c in chosen.columns])


_TEXT = ", ".join(f"coalesce(CAST({c}{k} AS VARCHAR), 'NaN') AS {c}{k}" for k in (1, 2) for c in "anr")


@query("r8_fill_missing", f"SELECT feature, {_TEXT} FROM fx_joined")
def r8(spark, sf_dir):
    return tables.fill_missing(_joined(spark, sf_dir), "NaN", keep=["feature"])


@query("f1_compare", "SELECT * FROM fx_joined WHERE a1 > 60")
def f1(spark, sf_dir):
    return tables.where(_joined(spark, sf_dir), "feature", [p.compare("a1", ">", 60)])


@query("f2_compare_all", "SELECT * FROM fx_joined WHERE a1 >= 20 AND n2 < 90 AND r2 <= 200")
def f2(spark, sf_dir):
    return tables.where(
        _joined(spark, sf_dir),
        "feature",
        [p.compare("a1", ">=", "20"), p.compare("n2", "<", 90), p.compare("r2", "<=", 2e2)],
    )


@query(
    "f4_limit_offset",
    """SELECT * FROM fx_joined
       ORDER BY CAST(substr(feature, 2) AS BIGINT) LIMIT 25 OFFSET 10""",
)
def f4(spark, sf_dir):
    return tables.page(_joined(spark, sf_dir), "feature", limit=25, offset=10)


@query("f5_filter_unselected", "SELECT feature, a2 FROM fx_joined WHERE n1 > 50 AND r2 > 10")
def f5(spark, sf_dir):
    kept = tables.where(
        _joined(spark, sf_dir), "feature", [p.compare("n1", ">", 50), p.compare("r2", ">", 10)]
    )
    return tables.select_columns(kept, "feature", ["a2"])


@query(
    "j1_outer_join",
    """SELECT x.feature, a1, n1, r1, a2, n2, r2 FROM fx_wide1 x LEFT JOIN fx_wide2 y ON x.feature = y.feature
       UNION
       SELECT y.feature, a1, n1, r1, a2, n2, r2 FROM fx_wide2 y LEFT JOIN fx_wide1 x ON x.feature = y.feature
       WHERE x.feature IS NULL""",
)
def j1(spark, sf_dir):
    return _joined(spark, sf_dir)


_LINES = range(1, 8)
_LINE_TABLES = ", ".join(
    f"t{k} AS (SELECT DISTINCT l_orderkey, l_quantity AS quantity{k}, l_returnflag AS flag{k} "
    f"FROM lineitem WHERE l_linenumber = {k})"
    for k in _LINES
)
_LINE_COLUMNS = ", ".join(f"quantity{k}, flag{k}" for k in _LINES)
_LINE_JOINS = " ".join(f"LEFT JOIN t{k} ON t{k}.l_orderkey = o.l_orderkey" for k in _LINES)


@query(
    "j1_many_tables",
    f"""WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem), {_LINE_TABLES},
            r AS (SELECT DISTINCT l_orderkey, l_partkey AS returned FROM lineitem WHERE l_returnflag = 'R')
        SELECT o.l_orderkey, {_LINE_COLUMNS}, returned
        FROM o {_LINE_JOINS} LEFT JOIN r ON r.l_orderkey = o.l_orderkey""",
)
def j1_many(spark, sf_dir):
    """A table for each line of an order and one of all returned parts, which repeats orders."""
    lines = fx.table(spark, sf_dir, "lineitem")
    parts = [
        lines.filter(F.col("l_linenumber") == k).select(
            "l_orderkey", F.col("l_quantity").alias(f"quantity{k}"), F.col("l_returnflag").alias(f"flag{k}")
        )
        for k in _LINES
    ]
    returned = lines.filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("returned"))
    return tables.outer_join_many([*parts, returned], "l_orderkey")


POOLED = [
    (f"GLDS-{a}", b, f"NATION_{n}") for a in (1, 2, 3) for b in ("f", "o") for n in range(25)
]


def _flat(name: str) -> str:
    return name.replace("/", "_").replace("-", "_")


def _pivot_sql(chosen, where="", having="") -> str:
    sums = ",\n".join(
        f"max(CASE WHEN accession = '{a}' AND assay_name = '{b}' AND sample_name = '{n}' "
        f"THEN value END) AS {_flat(f'{a}/{b}/{n}')}"
        for a, b, n in chosen
    )
    return f"SELECT feature, {sums} FROM fx_pooled {where} GROUP BY feature {having}"


@query("j2_long_to_wide", _pivot_sql(POOLED))
def j2(spark, sf_dir):
    long = fx.pooled_measurements(spark, sf_dir).withColumn("column", F.concat_ws("/", *SAMPLE))
    wide = tables.pivot_long(long, "feature", "column", "value", ["/".join(c) for c in POOLED])
    return wide.toDF(*map(_flat, wide.columns))


@query(
    "j2_repeated_index",
    """WITH cells AS (
           SELECT concat('G', CAST(l_partkey AS VARCHAR)) AS feature, l_returnflag AS flag, l_quantity AS value,
                  row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY l_quantity) AS nth FROM lineitem)
       SELECT feature, max(CASE WHEN flag = 'A' THEN value END) AS a, max(CASE WHEN flag = 'N' THEN value END) AS n,
              max(CASE WHEN flag = 'R' THEN value END) AS r
       FROM cells GROUP BY feature, nth""",
)
def j2_repeated(spark, sf_dir):
    """Every line of a part is a row of its own; no value is merged with another."""
    lines = fx.table(spark, sf_dir, "lineitem").select(
        fx.numbered("G", F.col("l_partkey")).alias("feature"),
        F.lower("l_returnflag").alias("flag"),
        F.col("l_quantity").alias("value"),
    )
    return tables.pivot_long(lines, "feature", "flag", "value", ["a", "n", "r"], repeated=True)


@query(
    "j3_natural_join",
    "SELECT x.feature, a1, n1, r1, a2, n2, r2 FROM fx_wide1 x JOIN fx_wide2 y ON x.feature = y.feature",
)
def j3(spark, sf_dir):
    return tables.natural_join(_wide(spark, sf_dir), "feature")


@query(
    "j4_joinable_files",
    """SELECT accession, filename, datatype FROM fx_typed WHERE datatype = 'unnormalized counts'""",
)
def j4(spark, sf_dir):
    """The joinable files of the listing, once they pass the checks."""
    files = fx.typed(spark, sf_dir).filter("joinable").withColumn(
        "technology", F.lit("RNA Sequencing (RNA-Seq)")
    )
    tables.check_joinable(files)
    return files.select("accession", "filename", "datatype")


_BEST = """SELECT n.accession, n.column_name, min(m.tier) AS tier, count(m.sample_name) AS n_matches,
       CASE WHEN count(m.sample_name) = 1 THEN min(m.sample_name) END AS sample_name
FROM fx_names n LEFT JOIN fx_matched m ON n.accession = m.accession AND n.column_name = m.column_name
GROUP BY 1, 2"""


def _best(spark, sf_dir):
    pairs = fx.names(spark, sf_dir)
    # the names of all datasets begin alike: a short one matches many in its tier
    short = pairs.select("accession", F.substring("column_name", 1, 9).alias("name"))
    own = pairs.select("accession", F.col("column_name").alias("name"))
    return own, short, pairs.select("accession", F.col("sample_name").alias("candidate"))


@query("j5_tiered_name_match", _BEST)
def j5(spark, sf_dir):
    own, _, candidates = _best(spark, sf_dir)
    matched = names.best_match(own, candidates, ["accession"])
    return matched.select(
        "accession",
        F.col("name").alias("column_name"),
        "tier",
        "n_matches",
        F.col("candidate").alias("sample_name"),
    )


@query(
    "j5_ambiguous_names",
    """SELECT accession, substr(column_name, 1, 9) AS name, 3 AS tier,
              count(DISTINCT sample_name) AS n_matches
       FROM (SELECT DISTINCT n.accession, substr(n.column_name, 1, 9) AS column_name, s.sample_name
             FROM fx_names n JOIN fx_names s ON n.accession = s.accession
             AND starts_with(regexp_replace(s.sample_name, '[._-]', '.', 'g'),
                             regexp_replace(substr(n.column_name, 1, 9), '[._-]', '.', 'g')))
       GROUP BY 1, 2 HAVING count(DISTINCT sample_name) > 1""",
)
def j5_ambiguous(spark, sf_dir):
    """Names that begin several sample names; a million matches cost one row."""
    _, short, candidates = _best(spark, sf_dir)
    found = names.ambiguous(names.best_match(short, candidates, ["accession"]))
    return found.select("accession", "name", "tier", "n_matches")


def _matched_columns(spark, sf_dir, keep):
    pairs = fx.names(spark, sf_dir)
    return names.match_columns(
        pairs.select("accession", F.col("column_name").alias("name")),
        pairs.select("accession", F.col("sample_name").alias("candidate")),
        ["accession"],
        keep_unmatched=keep,
    )


@query("j6_rename_columns", "SELECT accession, column_name, sample_name FROM fx_matched")
def j6(spark, sf_dir):
    matched = _matched_columns(spark, sf_dir, keep=False)
    return matched.select(
        "accession", F.col("name").alias("column_name"), F.col("harmonised").alias("sample_name")
    )


@query(
    "j6_column_order",
    """SELECT n.accession, n.column_name, n.column_name AS harmonised, n.c_custkey AS target
       FROM fx_names n WHERE n.c_custkey % 4 = 3
       UNION ALL
       SELECT m.accession, m.column_name, m.sample_name, s.c_custkey FROM (
           SELECT *, row_number() OVER (PARTITION BY accession ORDER BY sample_name) AS k FROM fx_matched) m
       JOIN (SELECT accession, c_custkey, row_number() OVER (PARTITION BY accession ORDER BY c_custkey) AS k
             FROM fx_names WHERE c_custkey % 4 <> 3) s ON m.accession = s.accession AND m.k = s.k""",
)
def j6_order(spark, sf_dir):
    original = fx.names(spark, sf_dir).select(
        "accession", F.col("column_name").alias("name"), F.col("c_custkey").alias("place")
    )
    ordered = names.column_order(_matched_columns(spark, sf_dir, keep=True), original, ["accession"])
    return ordered.select(
        "accession", F.col("name").alias("column_name"), "harmonised", "target"
    )


_CHOSEN_SQL = """(SELECT accession, assay_name, sample_name FROM fx_measured
    WHERE region IN ('ASIA', 'EUROPE') AND tier IS NOT NULL)"""


@query(
    "j7_metadata_selection",
    f"""SELECT m.accession, m.assay_name, m.sample_name, m.feature, m.value FROM fx_meas m
        WHERE (m.accession, m.assay_name, m.sample_name) IN {_CHOSEN_SQL}""",
)
def j7(spark, sf_dir):
    chosen = p.filter_samples(
        fx.measured_samples(spark, sf_dir),
        [p.eq("study.characteristics.region", "ASIA|EUROPE"), p.exists(fx.TIER)],
    )
    return file_ops.select_measurements(fx.measurements(spark, sf_dir), chosen)


@query(
    "j7_stored_selection",
    """SELECT assay_name, sample_name, feature, value, accession FROM fx_meas m
       WHERE accession IN ('GLDS-1', 'GLDS-3') AND (accession, assay_name, sample_name) IN (
           SELECT accession, assay_name, sample_name FROM fx_measured WHERE tier = 'high')""",
)
def j7_stored(spark, sf_dir):
    """The same selection on stored measurements: only the datasets selected are read."""
    path = scratch_path(spark, "measurements")
    store.write_measurements(fx.measurements(spark, sf_dir), path)
    chosen = p.filter_samples(
        fx.measured_samples(spark, sf_dir), [p.eq(fx.TIER, "high"), p.by_id("GLDS-1|GLDS-3")]
    )
    return file_ops.select_measurements(store.read_datasets(spark, path), chosen)


@query(
    "j8_match_index",
    """SELECT n.accession, coalesce(m.sample_name, n.column_name) AS sample_name,
              CAST(n.c_custkey AS DOUBLE) AS pc1
       FROM fx_names n LEFT JOIN fx_matched m
         ON n.accession = m.accession AND n.column_name = m.column_name""",
)
def j8(spark, sf_dir):
    """A table of components whose index is the sample name, as the file spells it."""
    components = fx.names(spark, sf_dir).select(
        "accession", F.col("column_name").alias("sample_name"), F.col("c_custkey").cast("double").alias("pc1")
    )
    matched = _matched_columns(spark, sf_dir, keep=True)
    return names.rename_samples(components, matched, ["accession"])


@query(
    "j11_align",
    """SELECT i.accession, i.assay_name, i.sample_name, a.nation
       FROM (SELECT DISTINCT accession, assay_name, sample_name FROM fx_meas) i
       LEFT JOIN (SELECT * FROM fx_measured WHERE tier IS NOT NULL) a
         ON i.accession = a.accession AND i.assay_name = a.assay_name AND i.sample_name = a.sample_name""",
)
def j11(spark, sf_dir):
    annotation = p.filter_samples(fx.measured_samples(spark, sf_dir), [p.exists(fx.TIER)])
    rows = annotation.select(*SAMPLE, F.col("attrs")[fx.NATION].alias("nation"))
    return file_ops.align(rows, fx.measurements(spark, sf_dir), SAMPLE)


# --- the data view, end to end ---------------------------------------------------------

_FLAGS = "ANR"
_TABLE = (
    "struct<filename:string,datatype:string,type:string,joinable:boolean,"
    "column_subset:string,index_subset:string,index_name:string>"
)


def _stored(spark, sf_dir, *kinds):
    """A repository of two datasets whose samples are the return flags, with some files stored."""
    store = TableStore(spark, scratch_path(spark, "tables"))
    items = fx.table(spark, sf_dir, "lineitem")
    part = fx.numbered("G", F.col("l_partkey")).alias("feature")
    if "lines" in kinds:
        cells = [F.when(F.col("l_returnflag") == f, F.col("l_quantity")).alias(f"{f.lower()}.1") for f in _FLAGS]
        store.store(items.select(part, *cells), "GLDS-1", "rna", "lines.csv")
    if "counts" in kinds:
        for k in (1, 2):
            names_of = ["feature", *[f"{f.lower()}_{k}" for f in _FLAGS]]
            store.store(fx.wide(spark, sf_dir, k).toDF(*names_of), f"GLDS-{k}", "rna", "counts.csv")
    if "words" in kinds:
        modes = items.groupBy(part).agg(F.min("l_linestatus").alias("state"), F.count(F.lit(1)).alias("lines"))
        store.store(modes, "GLDS-1", "rna", "words.csv")
    if "index" in kinds:
        flag = F.concat(F.lower("l_returnflag"), F.lit("_1_rep")).alias("name")
        store.store(items.groupBy(flag).agg(F.max("l_quantity").alias("PC1")), "GLDS-1", "rna", "pca.csv")
    described = [
        ("lines.csv", "lines", "table", None, "sample name", None, None),
        ("counts.csv", "unnormalized counts", "table", True, "sample name", None, None),
        ("words.csv", "differential expression", "table", None, None, None, None),
        ("pca.csv", "pca", "table", None, None, "sample name", "sample name"),
    ]
    files = F.array(*[F.struct(*map(F.lit, file)) for file in described]).cast(f"array<{_TABLE}>")
    flags = items.select("l_returnflag").distinct()
    samples = flags.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))).select(
        F.concat(F.lit("GLDS-"), F.col("k").cast("string")).alias("accession"),
        F.lit("rna").alias("assay_name"),
        F.concat(F.lower("l_returnflag"), F.lit("-"), F.col("k").cast("string")).alias("sample_name"),
        fx.annotated({"study.characteristics.flag": F.col("l_returnflag")}).alias("attrs"),
        files.alias("files"),
    )
    return Repository(samples, tables=store)


def _plain(table):
    return table.toDF(*[_flat(c).replace(" ", "_") for c in table.columns])


@query(
    "data_one_file",
    """SELECT concat('G', CAST(l_partkey AS VARCHAR)) AS feature,
              CASE WHEN l_returnflag = 'A' THEN l_quantity END AS GLDS_1_rna_a_1,
              CASE WHEN l_returnflag = 'R' THEN l_quantity END AS GLDS_1_rna_r_1 FROM lineitem""",
)
def data_one_file(spark, sf_dir):
    """A file with many rows per index value; only the selected samples' columns are read."""
    repository = _stored(spark, sf_dir, "lines")
    chosen = p.by_id("GLDS-1"), p.eq("file.datatype", "lines"), p.eq("study.characteristics.flag", "A|R")
    return _plain(repository.data(*chosen).table)


@query(
    "data_text_columns",
    """SELECT concat('G', CAST(l_partkey AS VARCHAR)) AS feature, min(l_linestatus) AS GLDS_1_rna_state,
              count(*) AS GLDS_1_rna_lines FROM lineitem GROUP BY 1 HAVING count(*) > 25""",
)
def data_text_columns(spark, sf_dir):
    repository = _stored(spark, sf_dir, "words")
    found = repository.data(
        p.by_id("GLDS-1"), p.eq("file.datatype", "differential expression"), comparisons=[p.compare("lines", ">", 25)]
    )
    return _plain(found.table)


@query(
    "data_joined_files",
    """SELECT feature, a1 AS GLDS_1_rna_a_1, n1 AS GLDS_1_rna_n_1, r1 AS GLDS_1_rna_r_1,
              a2 AS GLDS_2_rna_a_2, n2 AS GLDS_2_rna_n_2, r2 AS GLDS_2_rna_r_2 FROM fx_joined""",
)
def data_joined_files(spark, sf_dir):
    return _plain(_stored(spark, sf_dir, "counts").data(p.eq("file.datatype", "unnormalized counts")).table)


@query(
    "data_index_subset",
    """SELECT concat(lower(l_returnflag), '-1') AS sample_name, max(l_quantity) AS GLDS_1_rna_PC1
       FROM lineitem GROUP BY 1""",
)
def data_index_subset(spark, sf_dir):
    """A table whose index is the sample, spelled as the file has it."""
    return _plain(_stored(spark, sf_dir, "index").data(p.by_id("GLDS-1"), p.eq("file.datatype", "pca")).table)


# nations of the two regions whose number annotation exists
_SELECTED = [(a, b, n) for a, b, n in POOLED if int(n[7:]) % 5 in (2, 3) and int(n[7:]) % 4 != 0]


@query(
    "flagship_data_view",
    _pivot_sql(
        _SELECTED,
        where="WHERE " + "sample_name IN (" + ", ".join(f"'{n}'" for n in sorted({c[2] for c in _SELECTED})) + ")",
        having="HAVING max(CASE WHEN accession = 'GLDS-1' AND assay_name = 'o' "
        "AND sample_name = 'NATION_3' THEN value END) > 30",
    ),
)
def flagship(spark, sf_dir):
    """Counts of all samples of two regions that have a number, as one wide table,
    for the features above a count in one sample."""
    chosen = p.filter_samples(
        fx.pooled_samples(spark, sf_dir),
        [p.eq("study.characteristics.region", "ASIA|EUROPE"), p.exists("study.factor value.number")],
    )
    kept = file_ops.select_measurements(fx.pooled_measurements(spark, sf_dir), chosen)
    long = kept.withColumn("column", F.concat_ws("/", *SAMPLE))
    columns = tables.column_names(
        chosen.select(F.concat_ws("/", *SAMPLE).alias("column")), "column"
    )
    wide = tables.pivot_long(long, "feature", "column", "value", columns)
    result = tables.where(wide, "feature", [p.compare("GLDS-1/o/NATION_3", ">", 30)])
    return result.toDF(*map(_flat, result.columns))


# --- profiles --------------------------------------------------------------------------


def _profile_sql(columns, source, nan="count({c}) < count(*)"):
    parts = []
    for c in columns:
        if c == "feature":
            parts.append(
                f"SELECT 'feature' AS \"column\", 'str' AS type, CAST(NULL AS DOUBLE) AS min, "
                f"CAST(NULL AS DOUBLE) AS max, false AS has_nan, 'str[..]' AS description"
            )
        else:
            flag = nan.format(c=c)
            parts.append(
                f"SELECT '{c}', 'float', CAST(min({c}) AS DOUBLE), CAST(max({c}) AS DOUBLE), {flag}, "
                f"concat('float[(', min({c}), ')..(', max({c}), ')', "
                f"CASE WHEN {flag} THEN '|NaN]' ELSE ']' END) FROM {source}"
            )
    return "\nUNION ALL ".join(parts)


_COLUMNS = ["feature", "a1", "n1", "r1", "a2", "n2", "r2"]


@query("a3_profile", _profile_sql(_COLUMNS, "fx_joined"))
def a3(spark, sf_dir):
    return profile.profile(_joined(spark, sf_dir))


@query("a4_profile_before_join", _profile_sql(_COLUMNS, "fx_joined"))
def a4(spark, sf_dir):
    return profile.profile_outer_join(_wide(spark, sf_dir), "feature")


@query(
    "a3_profile_items",
    """SELECT c AS "column", type, lo AS min, hi AS max, false AS has_nan,
              CASE WHEN type = 'str' THEN 'str[..]'
                   WHEN type = 'int' THEN concat('int[(', CAST(lo AS BIGINT), ')..(', CAST(hi AS BIGINT), ')]')
                   ELSE concat('float[(', lo, ')..(', hi, ')]') END AS description
       FROM (SELECT 'l_partkey' AS c, 'int' AS type, CAST(min(l_partkey) AS DOUBLE) AS lo,
                    CAST(max(l_partkey) AS DOUBLE) AS hi FROM lineitem
       UNION ALL SELECT 'l_linenumber', 'int', CAST(min(l_linenumber) AS DOUBLE), CAST(max(l_linenumber) AS DOUBLE) FROM lineitem
       UNION ALL SELECT 'l_quantity', 'float', min(l_quantity), max(l_quantity) FROM lineitem
       UNION ALL SELECT 'l_extendedprice', 'float', min(l_extendedprice), max(l_extendedprice) FROM lineitem
       UNION ALL SELECT 'l_returnflag', 'str', NULL, NULL)""",  # noqa: E501
)
def a3_items(spark, sf_dir):
    items = fx.table(spark, sf_dir, "lineitem")
    return profile.profile(
        items.select("l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag")
    )


# --- analyses --------------------------------------------------------------------------

_KEY = "accession, assay_name, sample_name"
_NORMALISED = f"(SELECT *, value / avg(value) OVER (PARTITION BY {_KEY}) AS nv FROM fx_meas)"
_LOGGED = f"(SELECT *, ln(1e-6 + nv) AS lv FROM {_NORMALISED})"


def _rounded(df):
    return df.withColumn("value", F.round("value", 6))


@query("n1_normalise", f"SELECT {_KEY}, feature, round(nv, 6) AS value FROM {_NORMALISED}")
def n1(spark, sf_dir):
    return _rounded(analytics.normalise(fx.measurements(spark, sf_dir)))


@query("n2_log", f"SELECT {_KEY}, feature, round(lv, 6) AS value FROM {_LOGGED}")
def n2(spark, sf_dir):
    return _rounded(analytics.log_value(analytics.normalise(fx.measurements(spark, sf_dir)), 1e-6))


@query(
    "n2_log10",
    f"SELECT {_KEY}, feature, round(log10(.1 + value), 6) AS value FROM fx_meas",
)
def n2_log10(spark, sf_dir):
    return _rounded(analytics.log_value(fx.measurements(spark, sf_dir), 0.1, base=10))


@query(
    "n3_z_score",
    f"""SELECT {_KEY}, feature, round(CASE WHEN sd > 0 THEN (lv - mean) / sd END, 6) AS value FROM (
        SELECT *, avg(lv) OVER (PARTITION BY feature) AS mean,
               stddev_samp(lv) OVER (PARTITION BY feature) AS sd FROM {_LOGGED})""",
)
def n3(spark, sf_dir):
    logged = analytics.log_value(analytics.normalise(fx.measurements(spark, sf_dir)), 1e-6)
    return _rounded(analytics.z_score(logged))


@query(
    "n4_complete_rows",
    """SELECT feature, a1, n1, r1, a2, n2, r2 FROM fx_joined WHERE a1 IS NOT NULL AND n1 IS NOT NULL
       AND r1 IS NOT NULL AND a2 IS NOT NULL AND n2 IS NOT NULL AND r2 IS NOT NULL""",
)
def n4(spark, sf_dir):
    return analytics.rounded(analytics.complete_rows(_joined(spark, sf_dir), "feature"), "feature")


@query(
    "n4_filled_rows",
    "SELECT feature, " + ", ".join(f"coalesce({c}, 0.0) AS {c}" for c in _COLUMNS[1:]) + " FROM fx_joined",
)
def n4_filled(spark, sf_dir):
    return analytics.filled_rows(_joined(spark, sf_dir), "feature")


@query(
    "n4_complete_features",
    """SELECT accession, assay_name, sample_name, feature, value FROM fx_pooled
       WHERE feature IN (SELECT feature FROM fx_pooled GROUP BY feature HAVING count(value) = (
           SELECT max(n) FROM (SELECT count(value) AS n FROM fx_pooled GROUP BY feature)))""",
)
def n4_long(spark, sf_dir):
    """The features measured in the largest number of samples any feature has."""
    pooled = fx.pooled_measurements(spark, sf_dir)
    largest = pooled.groupBy("feature").agg(F.count("value").alias("n")).agg(F.max("n").alias("n"))
    return analytics.complete_features(pooled, largest).select(*SAMPLE, "feature", "value")


@query(
    "n5_most_variable",
    """SELECT accession, assay_name, sample_name, feature, value FROM fx_meas WHERE feature IN (
       SELECT feature FROM (SELECT feature, stddev_samp(value) AS sd FROM fx_meas GROUP BY feature)
       WHERE sd IS NOT NULL ORDER BY sd DESC, feature LIMIT 50)""",
)
def n5(spark, sf_dir):
    meas = fx.measurements(spark, sf_dir)
    return analytics.keep_features(meas, analytics.most_variable(meas)).select(*SAMPLE, "feature", "value")


_RESULTS = """(SELECT feature, a1 / (a1 + n1 + 100) AS padj, (a1 - n1) / 16 AS lfc FROM fx_wide1)"""


def _results(spark, sf_dir):
    a, n = F.col("a1"), F.col("n1")
    return fx.wide(spark, sf_dir, 1).select(
        "feature", (a / (a + n + 100)).alias("padj"), ((a - n) / 16).alias("lfc")
    )


@query(
    "n6_significance",
    f"""SELECT feature, round(padj, 6) AS padj, lfc, round(-log10(coalesce(padj, 1.0)), 6) AS neg_log10_p,
               coalesce(padj < .05 AND abs(lfc) > 2, false) AS significant FROM {_RESULTS}""",
)
def n6(spark, sf_dir):
    flagged = analytics.significance(_results(spark, sf_dir), fold_change="lfc")
    return flagged.withColumn("neg_log10_p", F.round("neg_log10_p", 6)).withColumn(
        "padj", F.round("padj", 6)
    )


@query(
    "n6_significant_rows",
    f"SELECT feature, round(padj, 6) AS padj, lfc FROM {_RESULTS} WHERE padj < .2 AND abs(lfc) > 1",
)
def n6_rows(spark, sf_dir):
    flagged = analytics.significance(
        _results(spark, sf_dir), fold_change="lfc", p_below=0.2, change_above=1
    )
    return analytics.significant_rows(flagged, "lfc").withColumn("padj", F.round("padj", 6))


@query("n7_largest_magnitude", "SELECT max(abs(value - 60)) AS vmax FROM fx_meas")
def n7(spark, sf_dir):
    shifted = fx.measurements(spark, sf_dir).withColumn("value", F.col("value") - 60)
    return analytics.largest_magnitude(shifted)


@query(
    "n8_recode",
    """SELECT accession, sample_name, replace(accession, '-', '_') AS batch,
              replace(technology, ' ', '.') AS level,
              CASE tier WHEN 'high' THEN 'orange' WHEN 'low' THEN 'skyblue' END AS colour
       FROM fx_samples""",
)
def n8(spark, sf_dir):
    attrs = F.col("attrs")
    return fx.samples(spark, sf_dir).select(
        "accession",
        "sample_name",
        analytics.batch_label(F.col("accession")).alias("batch"),
        analytics.factor_level(file_ops.technology()).alias("level"),
        analytics.recode(attrs[fx.TIER], {"high": "orange", "low": "skyblue"}).alias("colour"),
    )


@query(
    "n9_make_unique",
    """SELECT p_partkey, CASE WHEN k = 0 THEN p_name ELSE concat(p_name, '.', k) END AS unique_name
       FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k
             FROM part)""",
)
def n9(spark, sf_dir):
    parts = fx.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return analytics.make_unique(parts, "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


@query(
    "n10_design_matrix",
    """SELECT concat(i.accession, '/', i.assay_name, '/', i.sample_name) AS name,
              replace(i.accession, '-', '_') AS batch, a.region AS region, a.tier AS tier
       FROM (SELECT DISTINCT accession, assay_name, sample_name FROM fx_meas) i
       JOIN fx_measured a ON i.accession = a.accession AND i.assay_name = a.assay_name
        AND i.sample_name = a.sample_name""",
)
def n10(spark, sf_dir):
    attrs = F.col("attrs")
    return analytics.design_matrix(
        fx.measurements(spark, sf_dir),
        fx.measured_samples(spark, sf_dir).select(*SAMPLE, "attrs"),
        {
            "region": analytics.factor_level(attrs["study.characteristics.region"]),
            "tier": attrs[fx.TIER],
        },
    ).withColumn("region", F.replace("region", F.lit("."), F.lit(" ")))


# --- output ----------------------------------------------------------------------------


def _cells_sql(columns, missing="'NaN'"):
    return [f"coalesce(CAST({c} AS VARCHAR), {missing})" for c in columns]


def _line_sql(parts, sep):
    return f" || {sep} || ".join(parts)


_QUOTED = "'\"' || replace(feature, '\"', '\"\"') || '\"'"


@query(
    "w1_csv_lines",
    f"SELECT {_line_sql([_QUOTED, *_cells_sql(_COLUMNS[1:])], chr(39) + ',' + chr(39))} AS line FROM fx_joined",
)
def w1(spark, sf_dir):
    from assaylens.sinks.formats import delimited_lines

    return delimited_lines(_joined(spark, sf_dir), ",")


@query(
    "w1_tsv_lines",
    """SELECT '"' || accession || '"' || chr(9) || '"' || sample_name || '"' || chr(9)
              || coalesce('"' || tier || '"', 'NaN') || chr(9) || balance AS line FROM fx_samples""",
)
def w1_tsv(spark, sf_dir):
    from assaylens.sinks.formats import delimited_lines

    samples = fx.samples(spark, sf_dir).select(
        "accession",
        "sample_name",
        F.col("attrs")[fx.TIER].alias("tier"),
        F.split(F.col("attrs")[fx.BALANCE], " ")[0].cast("bigint").alias("balance"),
    )
    return delimited_lines(samples, "\t")


@query(
    "w2_json_rows",
    f"""SELECT '["' || feature || '"]' AS index_json,
               '[' || {_line_sql(_cells_sql(_COLUMNS[1:]), "','")} || ']' AS data_json FROM fx_joined""",
)
def w2(spark, sf_dir):
    from assaylens.sinks.formats import json_rows

    rows = json_rows(_joined(spark, sf_dir), ["feature"])
    return rows.select(F.col("index").alias("index_json"), F.col("data").alias("data_json"))


@query(
    "w3_gct_lines",
    f"""SELECT {_line_sql(["feature", "feature", *_cells_sql(_COLUMNS[1:], "''")], "chr(9)")} AS line
        FROM fx_joined""",
)
def w3(spark, sf_dir):
    from assaylens.sinks.formats import gct_lines

    return gct_lines(_joined(spark, sf_dir), "feature")


_ORDERED = """(SELECT *, CAST(row_number() OVER (ORDER BY accession, assay_name, sample_name) - 1 AS BIGINT) AS pos
    FROM fx_samples)"""


def _annotation(spark, sf_dir, path, value=None):
    attrs = F.col("attrs")
    return fx.samples(spark, sf_dir).select(
        *SAMPLE, (attrs[path] if value is None else value(attrs[path])).alias(path)
    )


@query(
    "w4_cls_continuous",
    f"SELECT pos, concat(CAST(balance AS VARCHAR), '.0') AS token FROM {_ORDERED}",
)
def w4(spark, sf_dir):
    from assaylens.sinks.formats import cls_continuous

    values = _annotation(spark, sf_dir, fx.BALANCE, lambda c: F.split(c, " ")[0])
    return cls_continuous(values, fx.BALANCE, SAMPLE)


@query(
    "w5_cls_discrete",
    f"""WITH named AS (SELECT * FROM {_ORDERED}),
        classes AS (SELECT nation, row_number() OVER (ORDER BY min(pos)) - 1 AS class_id
                    FROM named GROUP BY nation)
        SELECT pos, CAST(class_id AS VARCHAR) AS token FROM named JOIN classes USING (nation)""",
)
def w5(spark, sf_dir):
    from assaylens.sinks.formats import cls_discrete

    tokens, _ = cls_discrete(_annotation(spark, sf_dir, fx.NATION), fx.NATION, SAMPLE)
    return tokens


@query(
    "w5_cls_classes",
    f"""SELECT CAST(row_number() OVER (ORDER BY min(pos)) - 1 AS BIGINT) AS class_id, technology AS class,
               replace(technology, ' ', '_') AS label FROM {_ORDERED} GROUP BY technology""",
)
def w5_classes(spark, sf_dir):
    from assaylens.sinks.formats import cls_discrete

    _, classes = cls_discrete(_annotation(spark, sf_dir, fx.TECHNOLOGY), fx.TECHNOLOGY, SAMPLE)
    return classes
