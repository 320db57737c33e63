import gzip
import io
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaylens.errors import DataError
from assaylens.operators import shape
from assaylens.sources import isa, listing, tables

LINES = isa.LINE_SCHEMA


def tab(spark, header, *rows, kind="s"):
    """(headers, rows) of one tab."""
    lines = [("D", kind, "t", i, list(cells)) for i, cells in enumerate([header, *rows])]
    df = spark.createDataFrame(lines, LINES)
    return isa.tab_headers(df), isa.tab_rows(df)


def fields(spark, header, *rows, kind="s"):
    headers, body = tab(spark, header, *rows, kind=kind)
    out = isa.read_fields(body, isa.layouts(headers)).orderBy("line_no").collect()
    return [r["fields"] for r in out]


def test_protocol_reference_comes_from_the_last_column_even_when_it_is_null(spark):
    header = ["Protocol REF", "Source Name", "Protocol REF", "Parameter Value[pv]", "Characteristics[ch]"]
    with_ref, without = fields(spark, header, ["P1", "a", "P2", "1", "x"], ["P1", "b", "", "2", "y"])
    refs = lambda row: {f["field"]: f["protocol_ref"] for f in row}
    assert refs(with_ref) == {"Source Name": "P1", "Parameter Value": "P2", "Characteristics": None}
    assert refs(without) == {"Source Name": "P1", "Parameter Value": None, "Characteristics": None}


def test_qualifiers_belong_to_the_field_on_their_left(spark):
    header = [
        "Characteristics[Age]", "Unit", "Term Accession Number", "Comment[mood]", "Comment[mood]",
        "Term Source REF", "Sample Name",
    ]
    (row,) = fields(spark, header, ["36", "day", "T:1", "low", "high", "EFO", "s1"])
    age, sample = row
    assert (age["field"], age["subfield"], age["value"]) == ("Characteristics", "Age", "36")
    assert (age["unit"], age["term"]) == ("day", "T:1")
    assert age["comment"] == {"mood": "high"}  # the last one counts
    assert age["references"] == {"Term Source REF": "EFO"}
    assert (sample["value"], sample["unit"], sample["comment"]) == ("s1", None, {})


def test_repeated_fields_are_numbered(spark):
    (row,) = fields(spark, ["Raw Data File", "Sample Name", "Raw Data File"], ["a", "s", "b"])
    assert [(f["field"], f["ord"], f["value"]) for f in row] == [
        ("Raw Data File", 0, "a"), ("Sample Name", 0, "s"), ("Raw Data File", 1, "b"),
    ]


@pytest.mark.parametrize(
    "header, message",
    [
        (["Unit", "Sample Name"], "a tab begins with a column that describes another column"),
        (["Characteristics[Age]", "Characteristics[Age]"], "same field and subfield"),
        (["Characteristics[my.age]", "Characteristics[my_age]"], "two fields of a tab become one key; rename one of them"),
    ],
)
def test_bad_headers(spark, header, message):
    headers, _ = tab(spark, header, ["1", "2"])
    with pytest.raises(PySparkException, match=message):
        isa.layouts(headers).collect()


def test_annotation_of_a_tab(spark):
    header = ["Sample Name", "Characteristics[My.Age]", "Unit", "Raw Data File", "Raw Data File", "Factor Value[$Dose]"]
    headers, rows = tab(
        spark, header, ["s1", "36", "day", "a", "b", ""], ["s2", "7", "N/A", "c", "", "high"]
    )
    first, second = (r["attrs"] for r in isa.annotate(rows, isa.layouts(headers)).orderBy("line_no").collect())
    assert first == {
        "study.sample name": "s1", "study.characteristics.my_age": "36 {day}", "study.raw data file": "a, b",
    }
    assert second == {
        "study.sample name": "s2", "study.characteristics.my_age": "7", "study.raw data file": "c",
        "study.factor value._dose": "high",
    }


def test_own_unit_format(spark):
    headers, rows = tab(spark, ["Characteristics[Age]", "Unit"], ["36", "day"])
    marked = lambda v, u: F.concat(v, F.lit(" "), u, F.lit("s"))
    row = isa.annotate(rows, isa.layouts(headers), marked).first()
    assert row["attrs"] == {"study.characteristics.age": "36 days"}


def test_rows_repeat_and_blank_cells(spark):
    _, rows = tab(spark, ["Sample Name", "X[ab]"], ["s1", "NA"], ["s1", "null"], ["s2", "1"], ["s2", "1"])
    assert sorted((r["line_no"], r["cells"]) for r in rows.collect()) == [(1, ["s1", None]), (3, ["s2", "1"])]


def test_sample_names_of_rows(spark):
    headers, rows = tab(spark, ["Source Name", "Sample Name"], ["a", "s1"], ["b", ""])
    read = isa.with_names(rows, isa.layouts(headers))
    assert [r["sample_name"] for r in isa.named_rows(read).collect()] == ["s1"]
    assert [r["line_no"] for r in isa.unnamed_rows(read).collect()] == [2]

    headers, rows = tab(spark, ["Sample Name", "Sample Name"], ["s1", "s1"], ["s2", "s3"])
    read = isa.with_names(rows, isa.layouts(headers))
    assert [r["line_no"] for r in isa.conflicting_names(read).collect()] == [2]
    with pytest.raises(PySparkException, match="names several samples"):
        isa.named_rows(read).collect()

    headers, rows = tab(spark, ["Sample Name", "Source Name"], ["s1", "a"], ["s1", "b"])
    named = isa.named_rows(isa.with_names(rows, isa.layouts(headers)))
    assert [r["sample_name"] for r in isa.duplicate_samples(named).collect()] == ["s1"]

    headers, rows = tab(spark, ["Source Name", "X[ab]"], ["a", "s1"])
    with pytest.raises(PySparkException, match="no Sample Name column"):
        isa.with_names(rows, isa.layouts(headers)).collect()


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(f"folder/{name.replace('__', '.')}", content)
    return out.getvalue()


def test_archives(spark, tmp_path):
    whole = archive(
        i_all__txt=b"INVESTIGATION\nInvestigation Identifier\tD-1\n",
        s_one__txt='Source Name\tSample Name\n"a ""quoted""\tname"\ts1\n# left out\nb\xff\ts2'.encode("latin-1"),
        a_two__txt=b"Sample Name\ns1\n",
        notes__txt=b"x",
    )
    (tmp_path / "D-1_metadata_D-1-ISA.zip").write_bytes(whole)
    (tmp_path / "D-2_metadata_D-2-ISA.zip").write_bytes(archive(s_one__txt=b"Sample Name\ns1\n"))
    (tmp_path / "D-3.zip").write_bytes(archive(other__txt=b"nothing"))
    archives = isa.read_archives(spark, str(tmp_path))
    lines = isa.archive_lines(archives)
    found = {(r["accession"], r["kind"], r["tab"], r["line_no"]): r["cells"] for r in lines.collect()}
    assert found[("D-1", "s", "one", 1)] == ['a "quoted"\tname', "s1"]
    assert found[("D-1", "s", "one", 2)] == ["b�", "s2"]
    assert ("D-1", "a", "two", 1) in found
    missing = {(r["accession"], r["kind"]) for r in isa.missing_tabs(archives, lines).collect()}
    assert missing == {("D-2", "i"), ("D-2", "a"), ("D-3", "i"), ("D-3", "s"), ("D-3", "a")}


def investigation(spark, *lines):
    rows = [("D", "i", "all", i, list(cells)) for i, cells in enumerate(lines)]
    return isa.investigation_cells(spark.createDataFrame(rows, LINES))


def test_investigation(spark):
    cells = investigation(
        spark,
        ["INVESTIGATION"],
        ["Investigation Identifier", "D"],
        ["STUDY"],
        ["Study File Name", "s_one.txt"],
        ["Comment[Lab Tag]", "x"],
        ["STUDY ASSAYS"],
        ["Study Assay File Name", "a_x.txt", "a_y.txt", "bad.txt"],
        ["Study Assay Technology Type", "RNA", "", "z"],
        ["STUDY"],
        ["Study File Name", "s_two.txt"],
    )
    records = isa.investigation_records(cells)
    studies = isa.entity_records(records, "Study")
    assert {r["entity"] for r in studies.collect()} == {"one", "two"}
    assays = {r["entity"]: r["content"] for r in isa.entity_records(records, "Study Assays").collect()}
    assert assays["y"] == {"Study Assay File Name": "a_y.txt", "Study Assay Technology Type": None}
    assert isa.unnamed_entities(records, "Study Assays").count() == 1
    assert isa.wrong_record_counts(records).count() == 0
    comments = isa.fold_comments(cells, ["section", "record"]).first()
    assert (comments["comment"], comments["values"]) == ("Lab tag", ["x"])


def test_comments_of_one_name_are_a_list_unless_equal(spark):
    cells = investigation(
        spark, ["STUDY"], ["Comment[a tag]", "x", "x"], ["Comment[A Tag]", "x", "y"], ["INVESTIGATION"], ["k", ""]
    )
    folded = {r["record"]: r["values"] for r in isa.fold_comments(cells, ["section", "record"]).collect()}
    assert folded == {0: ["x"], 1: ["x", "y"]}
    assert isa.wrong_record_counts(isa.investigation_records(cells)).count() == 0


# --- shaping -----------------------------------------------------------------------------


def test_colliding_keys(spark):
    df = spark.createDataFrame([(1, "a.b"), (1, "A_b"), (2, "a$b")], "doc int, key string")
    with pytest.raises(DataError, match="become one key"):
        shape.harmonise_long(df, ["doc"])
    assert [r["key"] for r in shape.harmonise_long(df.filter("doc = 2"), ["doc"]).collect()] == ["a_b"]


def test_assembly_needs_an_unambiguous_study_row(spark):
    attrs = "map<string,string>"
    assays = spark.createDataFrame(
        [("D", "x", "s1", {"a": "1"}), ("D", "x", "lost", {})],
        f"accession string, assay_name string, sample_name string, attrs {attrs}",
    )
    schema = f"accession string, study_name string, sample_name string, attrs {attrs}"
    records = spark.createDataFrame([("D", "st", {"r": "1"})], f"accession string, study_name string, attrs {attrs}")
    names = spark.createDataFrame([("D", "x", {"t": "rna"})], f"accession string, assay_name string, attrs {attrs}")
    good = spark.createDataFrame([("D", "st", "s1_rep", {"b": "2"})], schema)
    out = {r["sample_name"]: r for r in shape.assemble(assays, good, names, records).collect()}
    assert out["s1"]["attrs"] == {"a": "1", "b": "2", "t": "rna", "r": "1"}
    assert (out["lost"]["study_name"], out["lost"]["attrs"]) == (None, {"t": "rna"})
    missing = shape.missing_studies(shape.assemble(assays, good, names, records))
    assert [r["sample_name"] for r in missing.collect()] == ["lost"]
    bad = spark.createDataFrame([("D", "st", "s1_a", {}), ("D", "st", "s1_b", {})], schema)
    with pytest.raises(PySparkException, match="several study rows"):
        shape.assemble(assays, bad, names, records).collect()


# --- listings ----------------------------------------------------------------------------


def test_all_rules_and_conflicts(spark):
    names = {
        "GLDS-1_metadata_GLDS-1-ISA.zip": "isa",
        "GLDS-4_array_normalized-annotated.txt": "processed microarray data",
        "GLDS-4_rna_seq_all-samples_Normalized_Counts.csv": "normalized counts",
        "GLDS-4_rna_seq_visualization_PCA_table.csv": "pca",
        "GLDS-4_x_trimmed.fastq": "trimmed reads",
        "xGLDS-4_x_trimmed.fastq": None,
    }
    df = spark.createDataFrame([(n,) for n in names], "filename string")
    typed = {r["filename"]: r for r in listing.typed_files(df).collect()}
    assert {n: r["datatype"] for n, r in typed.items()} == names
    pca = typed["GLDS-4_rna_seq_visualization_PCA_table.csv"]
    assert (pca["index_name"], pca["condition"], pca["cacheable"]) == ("sample name", "rna-seq", True)
    clash = spark.createDataFrame([("GLDS-1_metadata_.zip_raw.fastq_metadata_GLDS.zip",), ("a_metadata_.bam",)], "filename string")
    assert listing.conflicting_names(clash).count() == 0
    both = spark.createDataFrame([("GLDS-1_rna_seq_metadata_raw_multiqc_data.zip",), ("GLDS-1_rna_seq_raw_multiqc_data.zip",)], "filename string")
    assert listing.conflicting_names(both).count() == 0


def test_a_name_with_two_rules_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(listing, "RULES", (listing.Rule("a", "first"), listing.Rule("b$", "second")))
    df = spark.createDataFrame([("xab",), ("xa",)], "filename string")
    assert [r["filename"] for r in listing.conflicting_names(df).collect()] == ["xab"]
    with pytest.raises(PySparkException, match="several typing rules"):
        listing.typed_files(df).collect()


def test_listing_from_json(spark, tmp_path):
    (tmp_path / "l.json").write_text(
        '{"accession":"D-1","file_name":"f","version":"2","date_created":"1970-01-02","remote_url":"/r x"}\n'
        '{"accession":"D-1","file_name":"f","version":"1"}\n'
    )
    rows = listing.with_timestamp(listing.read_listing(spark, str(tmp_path)))
    rows = rows.withColumnRenamed("file_name", "filename")
    assert [r["n_files"] for r in listing.accessions(rows).collect()] == [2]
    latest = listing.latest_files(rows).collect()
    assert [(r["filename"], r["version"], r["ts"]) for r in latest] == [("f", "2", 86400)]
    urls = listing.with_urls(rows.filter("version = '2'"), "https://host", "/media/").first()["urls"]
    assert urls == ["https://host/media/f?version=2", "https://host/r%20x?version=2"]


# --- delimited tables --------------------------------------------------------------------


def test_read_table(spark, tmp_path):
    plain = tmp_path / "t.csv"
    plain.write_text('"",a,"b ""x"""\ng1,1,\ng2,NaN,word\n')
    df = tables.read_table(spark, str(plain), index_name="sample name")
    assert df.columns == ["sample name", "a", 'b "x"']
    assert [tuple(r) for r in df.orderBy("sample name").collect()] == [("g1", 1.0, None), ("g2", None, "word")]
    assert df.schema["a"].dataType == T.DoubleType()
    assert tables.read_table(spark, str(plain)).columns[0] == "index"
    packed = tmp_path / "t.tsv.gz"
    packed.write_bytes(gzip.compress(b"feature\ta,b\ng\t2\n"))
    assert tables.sniff_delimiter(spark, str(packed)) == "\t"
    assert tables.read_table(spark, str(packed)).collect()[0]["a,b"] == 2
    whole = tmp_path / "whole.csv"
    whole.write_text("f,i,d,s,e\ng,1,1.0,1,\nh,-7,2,x,\ni,,3,,\n")
    assert [k for _, k in tables.read_table(spark, str(whole)).dtypes] == ["string", "bigint", "double", "string", "double"]
    (tmp_path / "no.txt").write_text("just text\nno table\n")
    with pytest.raises(DataError, match="no delimiter"):
        tables.read_table(spark, str(tmp_path / "no.txt"))
    with pytest.raises(DataError, match="single column"):
        tables.read_table(spark, str(tmp_path / "no.txt"), sep=";")
    other = tmp_path / "other.csv"
    other.write_text("f;i;d;s;e\ng;1;1;1;1\n")
    with pytest.raises(Exception, match="header|MALFORMED|column"):
        tables.read_table(spark, [str(whole), str(other)]).collect()


def test_loading_checks_widths_and_replaces_one_accession(spark, tmp_path):
    paths = []
    for name, content in (("a", "f,x\ng1,1\n"), ("b", "f,x\ng2,2\n"), ("c", "f,x,y\ng,1,2\n"), ("d", "f,z\ng,1\n")):
        (tmp_path / f"{name}.csv").write_text(content)
        paths.append(str(tmp_path / f"{name}.csv"))
    schema = T.StructType([T.StructField("f", T.StringType()), T.StructField("x", T.DoubleType())])
    target = str(tmp_path / "out")
    for wrong in (paths[2], paths[3]):
        with pytest.raises(Exception, match="header|CSV"):
            tables.load_tables(spark, [paths[0], wrong], "D-1", 1, str(tmp_path / "wrong"), schema)
    tables.load_tables(spark, paths[:2], "D-1", 5, target, schema)
    tables.load_tables(spark, paths[:1], "D-2", 5, target, schema)
    tables.load_tables(spark, paths[1:2], "D-1", 9, target, schema)
    rows = spark.read.parquet(target).select("accession", "f", "x", "source_ts").collect()
    assert {tuple(r) for r in rows} == {("D-1", "g2", 2.0, 9), ("D-2", "g1", 1.0, 5)}
    (tmp_path / "bad.csv").write_text("f,x\ng1,word\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        tables.load_tables(spark, [str(tmp_path / "bad.csv")], "D-3", 1, target, schema)
