import json

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from assaylens.operators import documents
from assaylens.operators.files import attach_files
from assaylens.plans import ingest_queries  # noqa: F401
from assaylens.plans.registry import QUERIES, SQL
from assaylens.sources import isa

SF = "/root/testdata/sf0.001"
HEADER = [
    "Source Name", "Characteristics[Age, of. it]", "Unit", "Term Accession Number", "Comment[File]", "Comment[it's]",
    "Sample Name", "Protocol REF", "Parameter Value[Dose]", "Raw Data File", "Raw Data File", "Comment[Sum]",
]
ROWS = [
    ["src", "5", "week", "T:1", "x.csv , y.csv", "ok", "s1", "P1", "high", "a.bam", "b.bam", "md5"],
    ["src", "", "week", "", "", "", "s2", "", "low", "", "c.bam", ""],
]


@pytest.fixture(scope="module")
def rows(spark):
    lines = [("A", "s", "t", n, cells) for n, cells in enumerate([HEADER, *ROWS])]
    frame = spark.createDataFrame(lines, isa.LINE_SCHEMA)
    return isa.with_row_documents(isa.tab_rows(frame), isa.layouts(isa.tab_headers(frame)))


@pytest.mark.parametrize("name", ["h4_nested_documents", "j9_files_in_comments"])
def test_queries(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), SQL[name]) is None


def test_documents_keep_what_describes_a_value(rows):
    first, second = [json.loads(r.j) for r in rows.orderBy("line_no").select(F.to_json("document").alias("j")).collect()]
    age = next(iter(first["characteristics"].values()))
    assert age == {
        "": "5", "unit": "week", "term accession number": "T:1",
        "comment": {"File": "x.csv , y.csv", "it's": "ok"},
    }
    assert first["parameter value"]["dose"] == {"": "high", "protocol ref": "P1"}
    assert [f[""] for f in first["raw data file"]] == ["a.bam", "b.bam"]
    assert first["raw data file"][1]["comment"] == {"Sum": "md5"}
    assert next(iter(second["characteristics"].values())) == {"unit": "week"}
    assert second["parameter value"]["dose"] == {"": "low"}


def test_leaves_and_items(rows):
    found = {(r.line_no, r.path[0], r.path[-1], r.value) for r in documents.leaves(rows, ["line_no"]).collect()}
    assert (1, "characteristics", "it's", "ok") in found and (2, "characteristics", "unit", "week") in found
    # lists are not looked into
    assert not any(value.endswith(".bam") or value == "md5" for *_, value in found)
    items = {(r.line_no, r.item) for r in documents.leaf_items(rows, ["line_no"]).collect()}
    assert {(1, "x.csv"), (1, "y.csv"), (1, "high"), (2, "low")} <= items


def test_values_by_path(rows):
    dose, comment = ["parameter value", "dose"], ["parameter value", "dose", "comment", "none"]
    found = rows.orderBy("line_no").select(
        documents.value_at(dose).alias("dose"),
        documents.value_at([*dose, "protocol ref"]).alias("ref"),
        documents.value_at(comment).alias("none"),
        documents.value_at(["characteristics"]).alias("branch"),
    )
    assert [tuple(r) for r in found.collect()] == [("high", "P1", None, None), ("low", None, None, None)]


def test_record_documents(spark):
    lines = [
        ["STUDY"], ["Study File Name", "s_a.txt", "s_b.txt"], ["Study Title", "One", ""],
        ["Comment[file]", "x.txt", "y.txt"], ["Comment[File]", "x.txt", "z.txt"], ["Comment[Empty]", "", ""],
    ]
    frame = spark.createDataFrame([("A", "i", "all", n, c) for n, c in enumerate(lines)], isa.LINE_SCHEMA)
    cells = isa.investigation_cells(frame)
    records = isa.with_documents(isa.investigation_records(cells), cells).orderBy("record")
    found = [json.loads(r.j) for r in records.select(F.to_json("document").alias("j")).collect()]
    assert found == [
        {"study file name": "s_a.txt", "study title": "One", "comment": {"File": "x.txt"}},
        {"study file name": "s_b.txt", "comment": {"File": ["y.txt", "z.txt"]}},
    ]


def test_files_of_documents(spark, rows):
    samples = rows.select(
        "accession",
        F.lit("assay").alias("assay_name"),
        F.concat(F.lit("s"), "line_no").alias("sample_name"),
        F.create_map(F.lit("k"), F.lit("v")).alias("attrs"),
        "document",
    )
    names = [("A", n, None, None) for n in ("x.csv", "y.csv", "a.bam", "other", "low")] + [("B", "x.csv", None, None)]
    files = spark.createDataFrame(names, "accession string, filename string, condition string, internal boolean")
    found = {(r.sample_name, r.filename) for r in attach_files(samples, files).collect()}
    assert found == {("s1", "x.csv"), ("s1", "y.csv"), ("s2", "low")}


def test_empty_documents(spark, rows):
    none = rows.limit(0)
    assert documents.leaves(none, ["line_no"]).count() == 0
    blank = rows.select("line_no", F.lit(None).cast("variant").alias("document"))
    assert documents.leaves(blank, ["line_no"]).count() == 0


def test_keys_are_worked_out_once_per_tab(spark):
    lines = [("A", "s", "t", n, cells) for n, cells in enumerate([HEADER, *ROWS])]
    frame = spark.createDataFrame(lines, isa.LINE_SCHEMA)
    made = isa.layouts(isa.tab_headers(frame))
    stored = spark.createDataFrame(made.collect(), made.schema)
    read = isa.with_row_documents(isa.tab_rows(frame), stored)
    assert "regexp_replace" not in read._jdf.queryExecution().toString()
    found = documents.leaves(read, ["line_no"])
    assert "variant_explode" not in found._jdf.queryExecution().toString()
    assert found.where("value = 'week'").count() == 2


def test_leaves_of_lists_numbers_and_empty_objects(spark):
    frame = spark.sql("""SELECT parse_json('{"a": {}, "b": [{"c": "x"}, "y"], "d": 1, "e": {"f": "z", "g": ["s"]}, "h": null}') AS document""")
    assert [(r.path, r.value) for r in documents.leaves(frame, []).collect()] == [(["e", "f"], "z")]


def test_rows_of_a_tab_stay_where_they_are(spark):
    """What columns mean goes to the rows; rows do not meet by tab, where two tabs would be two tasks."""
    lines = [("A", "s", "t", n, cells) for n, cells in enumerate([HEADER, *ROWS])]
    frame = spark.createDataFrame(lines, isa.LINE_SCHEMA)
    layouts = isa.layouts(isa.tab_headers(frame))
    read = isa.with_names(isa.tab_rows(frame), layouts)
    read = isa.annotate(isa.with_row_documents(read, layouts), layouts)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 3 and "SortMergeJoin" not in plan


def test_row_elements_are_the_items_of_the_documents(spark):
    lines = [("A", "s", "t", n, cells) for n, cells in enumerate([HEADER, *ROWS])]
    lines += [("A", "s", "plain", 0, ["Sample Name"]), ("A", "s", "plain", 1, ["s3"]), ("A", "s", "plain", 2, [None])]
    frame = spark.createDataFrame(lines, isa.LINE_SCHEMA)
    layouts = isa.layouts(isa.tab_headers(frame))
    rows = isa.with_row_elements(isa.with_row_documents(isa.tab_rows(frame), layouts), layouts)
    expected = {(r.tab, r.line_no, r.item) for r in documents.leaf_items(rows, ["tab", "line_no"]).collect()}
    got = [(r.tab, r.line_no, e) for r in rows.collect() for e in r.elements]
    assert len(got) == len(set(got)) and set(got) == expected and ("t", 1, "y.csv") in expected
