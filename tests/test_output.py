import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from assaylens.api import Repository
from assaylens.errors import DataError, QueryError
from assaylens.operators import predicates as p
from assaylens.sinks import formats
from assaylens.sources.catalogue import TableStore


def document(path):
    """The fragments of a result, put together."""
    parts = sorted(Path(path).glob("*/part-*"))
    return "".join(f.read_bytes().decode() for f in parts)


@pytest.fixture
def table(spark):
    rows = [("g2", 1.0, None), ("g10", 2.5, 3e8), ('g"1', None, 4.0)]
    return spark.createDataFrame(rows, "feature string, `D-1/rna/s1` double, `D-2/rna/s2` double")


def test_csv(spark, table, tmp_path):
    formats.write_result(table, "data", "csv", str(tmp_path), index=["feature"])
    lines = document(tmp_path).splitlines()
    assert lines[:3] == ["#*,D-1,D-2", "#*,rna,rna", "#feature,s1,s2"]
    assert sorted(lines[3:]) == sorted(['"g2",1.0,NaN', '"g10",2.5,300000000.0', '"g""1",NaN,4.0'])


def test_tsv_of_annotation(spark, tmp_path):
    df = spark.createDataFrame([("D", "a,b", True)], "`id.accession` string, `study.factor value.x` string, `study.y` boolean")
    formats.write_result(df, "annotation", "tsv", str(tmp_path))
    assert document(tmp_path) == '#id\tstudy.factor value\tstudy.y\n#accession\tx\t*\n"D"\t"a,b"\tTrue\n'


def test_json_is_one_document(spark, table, tmp_path):
    formats.write_result(table, "data", "json", str(tmp_path / "a"), index=["feature"])
    text = document(tmp_path / "a")
    loaded = json.loads(text)
    assert loaded["meta"] == {"index_names": [["*", "*", "feature"]]}
    assert loaded["columns"] == [["D-1", "rna", "s1"], ["D-2", "rna", "s2"]]
    rows = {i[0]: d for i, d in zip(loaded["index"], loaded["data"])}
    assert rows["g10"] == [2.5, 3e8] and rows['g"1'][1] == 4.0 and rows["g2"][1] != rows["g2"][1]
    formats.write_result(table.limit(0), "data", "json", str(tmp_path / "b"), index=["feature"])
    assert json.loads(document(tmp_path / "b"))["data"] == []
    formats.write_result(table.filter("feature = 'g2'"), "data", "json", str(tmp_path / "c"), index=["feature"])
    assert json.loads(document(tmp_path / "c"))["index"] == [["g2"]]


def test_gct(spark, table, tmp_path):
    options = {"index": ["feature"], "datatypes": ["counts"], "gct_flags": [True]}
    formats.write_result(table, "data", "gct", str(tmp_path), **options)
    lines = document(tmp_path).splitlines()
    assert lines[:3] == ["#1.2", "3\t2", "Name\tDescription\tD-1/rna/s1\tD-2/rna/s2"]
    assert "g2\tg2\t1.0\t" in lines
    for change in ({"subset": True}, {"datatypes": ["a", "b"]}, {"datatypes": []}, {"gct_flags": [True, None]}):
        with pytest.raises(QueryError):
            formats.write_result(table, "data", "gct", str(tmp_path), **{**options, **change})


TARGET = "study.factor value.x"


def annotation(spark, values):
    rows = [("D", "a", f"s{i}", v) for i, v in values]
    schema = f"`id.accession` string, `id.assay name` string, `id.sample name` string, `{TARGET}` string"
    return spark.createDataFrame(rows, schema)


def test_continuous_classes(spark, tmp_path):
    df = annotation(spark, [(10, "3"), (2, "1.5"), (1, None), (3, "1.5")])
    formats.write_result(df, "annotation", "cls", str(tmp_path))
    assert document(tmp_path) == f"#numeric\n#{TARGET}\nnan\t1.5\t1.5\t3.0\n"


def test_discrete_classes(spark, tmp_path):
    df = annotation(spark, [(10, "Space Flight"), (2, "7"), (1, "Ground\tControl"), (3, "Space Flight")])
    formats.write_result(df, "annotation", "cls", str(tmp_path))
    assert document(tmp_path) == "4\t3\t1\n# Ground_Control\t7\tSpace_Flight\n0\t1\t2\t2\n"
    with pytest.raises(QueryError, match="continuous"):
        formats.write_result(df, "annotation", "cls", str(tmp_path), continuous=True)
    numbers = annotation(spark, [(1, "5"), (2, "5"), (3, "4")])
    formats.write_result(numbers, "annotation", "cls", str(tmp_path), continuous=False)
    assert document(tmp_path) == "3\t2\t1\n# 5\t4\n0\t0\t1\n"


def test_classes_need_a_value_and_one_column(spark, tmp_path):
    with pytest.raises(DataError, match="D/a/s1"):
        formats.write_result(annotation(spark, [(1, None), (2, "x")]), "annotation", "cls", str(tmp_path))
    df = annotation(spark, [(1, "x")])
    for bad in (df.drop(TARGET), df.withColumn("study.b.c", F.lit(1))):
        with pytest.raises(QueryError, match="exactly one"):
            formats.write_result(bad, "annotation", "cls", str(tmp_path))


@pytest.mark.parametrize("kind, fmt", [("data", "cls"), ("annotation", "gct"), ("schema", "gct"), ("data", "html"), ("x", "csv")])
def test_formats_suit_results(spark, table, tmp_path, kind, fmt):
    with pytest.raises(QueryError):
        formats.write_result(table, kind, fmt, str(tmp_path))


# --- the user-level queries --------------------------------------------------------------

FILE = (
    "struct<filename:string,datatype:string,type:string,joinable:boolean,gct_valid:boolean,"
    "column_subset:string,index_subset:string,index_name:string>"
)


@pytest.fixture(scope="module")
def repository(spark):
    counts = ("counts.csv", "unnormalized counts", "table", True, True, "sample name", None, None)
    pca = ("pca.csv", "pca", "table", None, None, None, "sample name", "sample name")
    statistics = ("de.csv", "differential expression", "table", None, None, None, None, None)
    reads = ("x.fastq", "raw reads", None, None, None, None, None, None)
    tech = {"investigation.study assays.study assay technology type": "RNA-Seq"}
    rows = [
        (d, "rna", s, {"study.factor value.flight": v, **tech}, [counts, pca, statistics, reads])
        for d, s, v in (("D-1", "s-1", "space"), ("D-1", "s-2", "ground"), ("D-2", "s-1", "space"), ("D-2", "t", "space"))
    ]
    samples = spark.createDataFrame(
        rows, f"accession string, assay_name string, sample_name string, attrs map<string,string>, files array<{FILE}>"
    )
    values = [
        ("D-1", "g1", "s.1", 1.0), ("D-1", "g1", "s.2", 2.0), ("D-1", "g2", "s.1", 3.0),
        ("D-2", "g1", "s_1_rep", 4.0), ("D-2", "g3", "t", 5.0), ("D-2", "g3", "length", 9.0),
    ]
    rows = [(d, "rna", "counts.csv", g, s, v) for d, g, s, v in values]
    rows += [("D-1", "rna", "pca.csv", s, c, v) for s, c, v in (("s_1", "PC1", 1.0), ("x", "PC2", 2.0))]
    rows += [("D-1", "rna", "de.csv", "g1", c, v) for c, v in (("Amean", 1.0), ("s.1", 2.0), ("s.2", 3.0))]
    measured = spark.createDataFrame(
        rows,
        "accession string, assay_name string, filename string, feature string, sample_name string, value double",
    )
    return Repository(samples, measured)


@pytest.fixture
def stored(spark, repository, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    counts = spark.createDataFrame(
        [("g1", 1.0, 2.0), ("g10", 3.0, None), ("g1", 5.0, 6.0), ("g2", 7.0, 8.0)], "feature string, `s.2` double, `s.1` double"
    )
    store.store(counts.coalesce(1), "D-1", "rna", "counts.csv")
    other = spark.createDataFrame([("g1", 4.0, 9.0), ("g3", 5.0, 9.0)], "feature string, s_1_rep double, length double")
    store.store(other, "D-2", "rna", "counts.csv")
    pca = spark.createDataFrame([("s_1", 1.0), ("x", 2.0), (None, 3.0)], "name string, PC1 double")
    store.store(pca.coalesce(1), "D-1", "rna", "pca.csv")
    words = spark.createDataFrame([("g1", "up", 3), ("g0", "down", None)], "gene string, direction string, `s.1` bigint")
    store.store(words.coalesce(1), "D-1", "rna", "de.csv")
    return Repository(repository.samples, tables=store)


def test_one_stored_file_comes_back_as_it_is(stored):
    one = (p.by_id("D-1"), p.eq("file.datatype", "unnormalized counts"))
    result = stored.data(*one)
    assert result.table.columns == ["feature", "D-1/rna/s-1", "D-1/rna/s-2"]
    assert [tuple(r) for r in result.table.collect()] == [
        ("g1", 2.0, 1.0), ("g10", None, 3.0), ("g1", 6.0, 5.0), ("g2", 8.0, 7.0),
    ]
    some = stored.data(*one, p.eq("study.factor value.flight", "space"), comparisons=[p.compare("s-1", ">", 2)])
    assert [tuple(r) for r in some.table.collect()] == [("g1", 6.0), ("g2", 8.0)]
    paged = stored.data(*one, limit=2, offset=1, columns=["s-2"])
    assert [tuple(r) for r in paged.table.collect()] == [("g1", 5.0), ("g2", 7.0)]


def test_stored_text_and_sample_index(stored):
    words = stored.data(p.by_id("D-1"), p.eq("file.datatype", "differential expression")).table
    assert words.columns == ["gene", "D-1/rna/direction", "D-1/rna/s-1"]
    assert [tuple(r) for r in words.collect()] == [("g1", "up", 3), ("g0", "down", None)]
    pca = stored.data(p.by_id("D-1"), p.eq("file.datatype", "pca"))
    assert pca.index == "sample name"
    assert [tuple(r) for r in pca.table.collect()] == [("s-1", 1.0), ("x", 2.0), (None, 3.0)]


def test_stored_files_are_joined(stored):
    result = stored.data(p.eq("file.datatype", "unnormalized counts"))
    assert result.table.columns == ["feature", "D-1/rna/s-1", "D-1/rna/s-2", "D-2/rna/s-1"]
    rows = [tuple(r) for r in result.table.collect()]
    assert [r[0] for r in rows] == ["g1", "g1", "g2", "g3", "g10"]
    assert sorted(rows[:2]) == [("g1", 2.0, 1.0, 4.0), ("g1", 6.0, 5.0, 4.0)] and rows[3] == ("g3", None, None, 5.0)
    with pytest.raises(DataError, match="not stored"):
        Repository(stored.samples, tables=TableStore(stored.tables.spark, stored.tables.root)).data(
            p.by_id("D-2"), p.eq("file.datatype", "pca")
        )


def test_data_of_selected_samples(repository, tmp_path):
    predicates = (p.eq("file.datatype", "unnormalized counts"), p.eq("study.factor value.flight", "space"))
    result = repository.data(*predicates)
    assert result.table.columns == ["feature", "D-1/rna/s-1", "D-2/rna/s-1", "D-2/rna/t"]
    assert sorted(map(tuple, result.table.collect()))[0] == ("g1", 1.0, 4.0, None)
    assert (result.datatypes, result.gct_flags) == (("unnormalized counts",), (True,))
    result.write("gct", str(tmp_path))
    assert document(tmp_path).startswith("#1.2\n3\t3\n")
    some = repository.data(*predicates, columns=["t"], comparisons=[p.compare("D-1/rna/s-1", ">=", 1)])
    assert sorted(map(tuple, some.table.collect())) == [("g1", None), ("g2", None)]
    with pytest.raises(QueryError, match="column selection"):
        some.write("gct", str(tmp_path / "x"))
    paged = repository.data(*predicates, limit=1, offset=1)
    assert [r["feature"] for r in paged.table.collect()] == ["g2"]
    assert {r["column"]: r["has_nan"] for r in result.profile().collect()}["D-2/rna/t"] is True


def test_data_queries_that_cannot_be_answered(repository):
    with pytest.raises(QueryError, match="file predicate"):
        repository.data(p.exists("study.factor value.flight"))
    with pytest.raises(DataError, match="several datatypes"):
        repository.data(p.exists("file.datatype"))
    with pytest.raises(DataError, match="of this datatype"):
        repository.data(p.eq("file.datatype", "pca"))
    with pytest.raises(DataError, match="no file fits"):
        repository.data(p.eq("file.datatype", "nothing"))


def test_files_whose_columns_are_not_samples(repository):
    one = (p.by_id("D-1"), p.eq("study.factor value.flight", "space"))
    result = repository.data(p.eq("file.datatype", "differential expression"), *one)
    assert result.table.columns == ["feature", "D-1/rna/Amean", "D-1/rna/s-1", "D-1/rna/s-2"]
    assert [tuple(r) for r in result.table.collect()] == [("g1", 1.0, 2.0, 3.0)]
    result = repository.data(p.eq("file.datatype", "pca"), *one)
    assert result.table.columns == ["sample name", "D-1/rna/PC1", "D-1/rna/PC2"]
    assert sorted(map(tuple, result.table.collect()), key=str) == [("s-1", 1.0, None), ("x", None, 2.0)]
    with pytest.raises(DataError, match="only tables"):
        repository.data(p.eq("file.filename", "x.fastq"), *one)


def test_views_of_a_repository(repository):
    view = repository.samples_view(p.eq("study.factor value.flight", "ground"))
    assert [tuple(r) for r in view.collect()] == [("D-1", "rna", "s-2", "ground")]
    assert repository.assays_view(p.exists("study.factor value.flight")).count() == 2
    assert {r["value"] for r in repository.facets().filter("key = 'flight'").collect()} == {"space", "ground"}
