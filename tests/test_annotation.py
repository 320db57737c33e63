import pytest
from pyspark.sql import functions as F

from assaylens.errors import QueryError
from assaylens.operators import files as file_ops
from assaylens.operators import predicates as p
from assaylens.operators import views
from assaylens.operators.lists import listed_values
from assaylens.operators.order import natural_order, sort_naturally
from assaylens.operators.ranking import with_position
from assaylens.operators.shape import bad_names, leaf_elements, move_material_type

SCHEMA = (
    "accession string, assay_name string, sample_name string, study_name string, "
    "attrs map<string,string>, files array<struct<filename:string,datatype:string>>"
)
ORGANISM, DOSE = "study.characteristics.organism", "study.factor value.dose"


@pytest.fixture(scope="module")
def samples(spark):
    rows = [
        ("D-2", "rna", "s10", "st", {ORGANISM: "Mus musculus", DOSE: "1"}, [("f1", "counts"), ("f2", None)]),
        ("D-2", "rna", "s9", "st", {ORGANISM: "mus"}, []),
        ("D-10", "rna", "a/b", "st", {ORGANISM: "Homo", "study.characteristics.sex": "f"}, [("f1", "counts")]),
        ("D-10", "array", "s1", None, {"assay.parameter value.kit": "k", "study.characteristics.comment": "c"}, None),
    ]
    return spark.createDataFrame(rows, SCHEMA).cache()


def chosen(samples, *predicates):
    return sorted(r["sample_name"] for r in p.filter_samples(samples, predicates).collect())


def test_predicates(samples):
    assert chosen(samples, p.eq(ORGANISM, "mus|Homo")) == ["a/b", "s9"]
    assert chosen(samples, p.matches(ORGANISM, "mus")) == ["s10", "s9"]
    assert chosen(samples, p.matches(ORGANISM, "^mus")) == ["s9"]
    assert chosen(samples, p.exists(DOSE)) == ["s10"]
    assert chosen(samples, p.any_exists("study.characteristics", ["sex", "age"])) == ["a/b"]
    assert chosen(samples, p.block_exists("assay.parameter value")) == ["s1"]
    assert chosen(samples, p.by_id("D-2/rna/s9|D-10")) == ["a/b", "s1", "s9"]
    assert chosen(samples, p.by_id("D-10/rna/a/b")) == ["a/b"]
    assert chosen(samples, p.exists(ORGANISM), p.exists(DOSE), p.eq("id.accession", "D-2")) == ["s10"]
    assert chosen(samples, p.exists("id.study name")) == ["a/b", "s10", "s9"]


def test_long_id_lists_select_the_same(spark, samples):
    many = [f"X-{i}/rna" for i in range(5000)]
    for ids in (["D-2/rna/s9", "D-10", "D-10/rna"], ["D-10/rna"], ["D-2/rna/s9"]):
        assert chosen(samples, p.by_id(*ids, *many)) == chosen(samples, p.by_id(*ids))
    rows = [("D", "a", "s"), ("D", "a", None), ("D", None, "s"), (None, "a", "s"), ("D/a", None, "s")]
    df = spark.createDataFrame(rows, "accession string, assay_name string, sample_name string")
    for n in (0, 300):
        extra = [f"X-{i}" for i in range(n)]
        assert p.filter_samples(df, [p.by_id("D", *extra)]).count() == 3
        assert p.filter_samples(df, [p.by_id("D/a", *extra)]).count() == 2
        assert p.filter_samples(df, [p.by_id("D/a/s", *extra)]).count() == 1


def test_file_predicates_choose_files_as_well(samples):
    found = p.filter_samples(samples, [p.eq("file.datatype", "counts")])
    assert sorted((r["sample_name"], r["file"]["filename"]) for r in found.collect()) == [
        ("a/b", "f1"), ("s10", "f1"),
    ]
    assert p.filter_samples(samples, [p.exists("file.filename")]).count() == 3


@pytest.mark.parametrize(
    "make",
    [
        lambda: p.eq("nothing.x", "1"),
        lambda: p.eq("study", "1"),
        lambda: p.exists("study.samples.x"),
        lambda: p.exists("study.characteristics.a.b"),
        lambda: p.exists("file.datatype.x"),
        lambda: p.eq("study.characteristics", "x"),
        lambda: p.block_exists("study.characteristics.organism"),
        lambda: p.block_exists("id.accession"),
        lambda: p.any_exists("study.characteristics", []),
        lambda: p.exists("study."),
    ],
)
def test_unknown_fields(make):
    with pytest.raises(QueryError):
        make()


def test_paths():
    assert views.reduce_paths(["a.b.c", "a.b", "a.bc", "d"]) == ["a.b", "a.bc", "d"]
    assert views.ordered_paths(["study.b.c", "assay.x.y", "id.z", "file.f", "investigation.s.t", "study.a.z"]) == [
        "id.z", "investigation.s.t", "study.a.z", "study.b.c", "assay.x.y", "file.f",
    ]
    assert views.header_levels("study.characteristics.organism") == ("study.characteristics", "organism")
    assert views.header_levels("study.characteristics") == ("study.characteristics", "*")
    assert views.header_levels("id.sample name") == ("id", "sample name")


def test_samples_view(samples):
    table = views.samples_view(samples, p.block_exists("study.characteristics"))
    assert table.columns == [
        "id.accession", "id.assay name", "id.sample name", "id.study name",
        "study.characteristics.comment", "study.characteristics.organism", "study.characteristics.sex",
    ]
    assert [r["id.sample name"] for r in table.collect()] == ["s9", "s10", "s1", "a/b"]
    empty = views.samples_view(samples, p.eq(ORGANISM, "nobody"))
    assert empty.count() == 0
    with_files = views.samples_view(samples, p.eq("file.datatype", "counts"), fields=[DOSE])
    assert with_files.columns[-3:] == [DOSE, "file.datatype", "file.filename"]


def test_assays_view_covers_all_samples_of_an_assay(samples):
    """The field may be on any sample, not just on the last one."""
    table = views.assays_view(samples, fields=[DOSE, ORGANISM])
    assert table.columns[2:] == [ORGANISM, DOSE]
    assert [tuple(r) for r in table.collect()] == [
        ("D-2", "rna", True, True), ("D-10", "array", False, False), ("D-10", "rna", True, False),
    ]


def test_facets(samples):
    found = {(r["category"], r["subfield"], r["key"], r["value"]) for r in views.facet_values(samples).collect()}
    assert ("study", "characteristics", "comment", "c") not in found
    assert ("study", "factor value", "dose", "1") in found
    listed = views.facet_lists(samples).filter("key = 'organism'").orderBy("position").collect()
    assert [(r["position"], r["value"], r["n_values"]) for r in listed] == [
        (0, "Homo", 3), (1, "Mus musculus", 3), (2, "mus", 3),
    ]
    assert {r["key"] for r in views.facet_keys(samples).collect()} == {"organism", "dose", "sex", "kit"}
    assert views.facet_blocks(samples).count() == 3
    assert [(r["accession"], r["assay_name"]) for r in views.assays_by_accession(samples).collect()] == [
        ("D-2", "rna"), ("D-10", "array"), ("D-10", "rna"),
    ]
    assert [r["datatype"] for r in views.datatypes(samples).collect()] == ["counts"]


def test_long_lists_are_rows_in_order(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") < 900, "hot").alias("k"), F.format_string("v%04d", "id").alias("v")
    )
    rows = listed_values(df, ["k"], "v", "v").collect()
    hot = sorted((r["position"], r["v"]) for r in rows if r["k"] == "hot")
    assert hot == [(i, f"v{i:04d}") for i in range(900)]
    rest = sorted((r["position"], r["v"], r["n_values"]) for r in rows if r["k"] is None)
    assert rest == [(i, f"v{900 + i:04d}", 100) for i in range(100)]


def test_positions_with_a_hot_group(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        ((F.col("id") * 7919) % 5003).alias("x"),
    )
    placed = with_position(df, [F.col("x")], ["g"]).collect()
    by_group = {}
    for r in placed:
        by_group.setdefault(r["g"], []).append((r["pos"], r["x"]))
    assert sum(map(len, by_group.values())) == 5000
    for rows in by_group.values():
        rows.sort()
        assert [pos for pos, _ in rows] == list(range(len(rows)))
        assert [x for _, x in rows] == sorted(x for _, x in rows)
    overall = with_position(df, [F.col("x").desc()]).collect()
    assert [r["pos"] for r in sorted(overall, key=lambda r: -r["x"])] == list(range(5000))


def test_sorting(spark):
    df = spark.createDataFrame([("s10", 1), ("s9", 2), (None, 3), ("s9", 10)], "n string, k int")
    assert [tuple(r) for r in sort_naturally(df, ["n", "k"], [True, False]).collect()] == [
        (None, 3), ("s9", 10), ("s9", 2), ("s10", 1),
    ]
    assert [r["n"] for r in sort_naturally(df, ["n"], [False]).collect()] == ["s10", "s9", "s9", None]
    with pytest.raises(ValueError):
        natural_order(["n"], [True, False])


def test_files_of_samples(spark, samples):
    assert [r["sample_name"] for r in file_ops.samples_of_file(samples, "D-2", "rna", "f2").collect()] == ["s10"]
    assert file_ops.files_with_samples(samples).count() == 3
    found = p.filter_samples(samples, [p.exists("file.filename")])
    rows = file_ops.file_descriptors(found).collect()
    assert {(r["accession"], r["filename"], r["position"], r["sample_name"]) for r in rows} == {
        ("D-2", "f1", 0, "s10"), ("D-2", "f2", 0, "s10"), ("D-10", "f1", 0, "a/b"),
    }


def test_attached_files(spark):
    tech = file_ops.TECHNOLOGY
    rows = [
        ("D", "x", "s1", {tech: "RNA Sequencing (RNA-Seq)", "assay.raw data file": "r1 , r2"}),
        ("D", "y", "s2", {tech: "DNA Microarray"}),
        ("E", "x", "s3", {}),
    ]
    docs = spark.createDataFrame(rows, "accession string, assay_name string, sample_name string, attrs map<string,string>")
    docs = docs.withColumn("elements", leaf_elements(F.col("attrs")))
    listed = [
        ("D", "r1", None, None), ("D", "r2", None, "microarray"), ("D", "r9", None, None),
        ("D", "zip", True, None), ("D", "pca", True, "microarray"), ("E", "r1", None, None),
    ]
    table = spark.createDataFrame(listed, "accession string, filename string, internal boolean, condition string")
    got = {(r["sample_name"], r["filename"]) for r in file_ops.attach_files(docs, table).collect()}
    assert got == {("s1", "r1"), ("s1", "zip"), ("s2", "zip"), ("s2", "pca")}


def test_align_gives_one_row_per_id(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    ids = spark.createDataFrame([("b",), ("c",), ("c",)], "id string")
    assert {tuple(r) for r in file_ops.align(rows, ids, ["id"]).select("id", "v").collect()} == {("b", 2), ("c", None)}


def test_material_type(spark):
    old, new = "study.material type", "study.characteristics.material type"
    cases = [
        ({old: "liver"}, {old: "liver", new: "liver"}),
        ({old: "liver", new: "skin"}, {old: "liver", new: "skin"}),
        ({old: "  ", "x": "1"}, {"x": "1"}),
        ({old: "liver, skin"}, {old: "liver, skin"}),
        ({new: "\t "}, {}),
        ({old: "liver "}, {old: "liver ", new: "liver "}),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m map<string,string>")
    got = df.orderBy("i").select(move_material_type(F.col("m")).alias("m")).collect()
    assert [r["m"] for r in got] == [expected for _, expected in cases]


def test_bad_names(spark):
    df = spark.createDataFrame([("D", "a/b"), ("D$", "a"), ("D", "a"), (None, None)], "accession string, assay_name string")
    assert bad_names(df).count() == 2


@pytest.mark.parametrize("most", [file_ops.MOST_RULES, 0])
def test_files_meet_samples_that_stay_where_they_are(spark, monkeypatch, most):
    """A text most samples have is no key of a shuffle; repeated samples and files count as before."""
    monkeypatch.setattr(file_ops, "MOST_RULES", most)
    tech = {file_ops.TECHNOLOGY: "DNA Microarray"}
    rows = [("D", "x", f"s{n // 2}", tech, ["none", "none", f"r{n // 2}"]) for n in range(8)]
    rows += [("D", "y", None, None, ["r1"]), (None, "x", "s0", tech, ["r1"]), ("D", "x", "s9", tech, None)]
    schema = "accession string, assay_name string, sample_name string, attrs map<string,string>, elements array<string>"
    listed = [("D", "r1", None, None), ("D", "r1", False, None), ("D", "r2", None, "rna-seq"), ("D", "zip", True, None)]
    table = spark.createDataFrame(listed, "accession string, filename string, internal boolean, condition string")
    got = file_ops.attach_files(spark.createDataFrame(rows, schema), table)
    found = sorted((tuple(r) for r in got.collect()), key=str)
    named = [("D", "x", "s1", "r1"), ("D", "y", None, "r1")] * 2
    internal = [("D", "x", f"s{n // 2}", "zip") for n in range(8)] + [("D", "y", None, "zip"), ("D", "x", "s9", "zip")]
    assert found == sorted(named + internal, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("SortMergeJoin" in plan) == (most == 0)
