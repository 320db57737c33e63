import io
import zipfile

import pytest

from assaylens.api import Repository
from assaylens.errors import DataError
from assaylens.ingest import build_samples, ingest
from assaylens.operators import predicates as p

INVESTIGATION = """INVESTIGATION
Investigation Title\tAll
STUDY
Study File Name\ts_st.txt
Study Title\tMice
STUDY ASSAYS
Study Assay File Name\ta_rna.txt
Study Assay Technology Type\tRNA Sequencing (RNA-Seq)
"""
STUDY = "Source Name\tSample Name\tCharacteristics[Age]\tUnit\tMaterial Type\nm1\ts-1\t36\tday\tliver\nm2\ts-2\t7\t\t\n"
ASSAY = "Sample Name\tParameter Value[Reads]\tRaw Data File\ns.1\tr1.fq , r2.fq\tlisted.txt\ns.2\t\t\n\t\t\n"
FILES = (
    "accession string, filename string, datatype string, internal boolean, condition string, "
    "type string"
)


def archive(i=INVESTIGATION, s=STUDY, a=ASSAY):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in (("i_x.txt", i), ("s_st.txt", s), ("a_rna.txt", a)):
            if content is not None:
                z.writestr(name, content)
    return out.getvalue()


def inputs(spark, **archives):
    content = spark.createDataFrame(list(archives.items()), "accession string, content binary")
    files = [
        (d, *f)
        for d in archives
        for f in (
            ("x.zip", "isa", True, None, None),
            ("r1.fq", "raw reads", None, None, None),
            ("listed.txt", "text", None, None, None),
            ("pca.csv", "pca", True, "rna-seq", "table"),
            ("array.csv", "pca", True, "microarray", "table"),
        )
    ]
    return content, spark.createDataFrame(files, FILES)


def test_samples_of_a_dataset(spark):
    samples = build_samples(*inputs(spark, D=archive()))
    rows = {r["sample_name"]: r for r in samples.collect()}
    assert set(rows) == {"s.1", "s.2"}
    first = rows["s.1"]
    assert (first["accession"], first["assay_name"], first["study_name"]) == ("D", "rna", "st")
    assert first["attrs"] == {
        "study.source name": "m1",
        "study.sample name": "s-1",
        "study.characteristics.age": "36 {day}",
        "study.material type": "liver",
        "study.characteristics.material type": "liver",
        "assay.sample name": "s.1",
        "assay.parameter value.reads": "r1.fq , r2.fq",
        "assay.raw data file": "listed.txt",
        "investigation.study assays.study assay technology type": "RNA Sequencing (RNA-Seq)",
        "investigation.study assays.study assay file name": "a_rna.txt",
        "investigation.study.study file name": "s_st.txt",
        "investigation.study.study title": "Mice",
        "investigation.investigation.investigation title": "All",
    }
    assert [f["filename"] for f in first["files"]] == ["pca.csv", "r1.fq", "x.zip"]
    assert [f["filename"] for f in rows["s.2"]["files"]] == ["pca.csv", "x.zip"]
    assert Repository(samples).samples_view(p.matches("study.characteristics.age", "day")).count() == 1


def test_a_bad_dataset_leaves_the_others_alone(spark):
    bad = {
        "no_study": archive(s=None),
        "early": archive(s="Unit\tSample Name\nday\ts-1\n"),
        "twice": archive(s="Sample Name\tXx[ab]\tXx[ab]\ns-1\t1\t2\n"),
        "collide": archive(s="Sample Name\tXx[a.b]\tXx[a_b]\ns-1\t1\t2\n"),
        "repeated": archive(s="Sample Name\tSource Name\ns-1\ta\ns-1\tb\n"),
        "conflict": archive(a="Sample Name\tSample Name\ns.1\ts.2\n"),
        "ambiguous": archive(s="Sample Name\ns.1.a\ns.1.b\n"),
        "unnamed": archive(i=INVESTIGATION.replace("a_rna.txt", "rna.txt")),
        "corrupt": archive()[:200],
        "no_zip": b"not a zip at all",
        "open": archive(s=STUDY.replace("liver", '"liver')),
        "open_i": archive(i=INVESTIGATION.replace("Mice", '"Mice')),
        "nameless": archive(s="Source Name\tCharacteristics[Age]\nm1\t3\n"),
    }
    good = {
        "good": archive(),
        "inner": archive(i=INVESTIGATION.replace("Mice", '"Mice called "Mus" here"')),
        "huge": archive(s=STUDY.replace("liver", "x" * 200_000)),
    }
    samples, failures = ingest(*inputs(spark, **good, **bad))
    rows = samples.collect()
    assert {r["accession"] for r in rows} == set(good) and len(rows) == 6
    titles = {r["accession"]: r["attrs"]["investigation.study.study title"] for r in rows}
    assert titles["inner"] == 'Mice called "Mus" here'
    assert all("investigation.study assays.study assay technology type" in r["attrs"] for r in rows)
    assert {r["accession"]: r["reason"] for r in failures.collect()} == {
        "no_study": "missing tab",
        "early": "a tab begins with a column that describes another column",
        "twice": "two columns of a tab have the same field and subfield",
        "collide": "two fields of a tab become one key; rename one of them",
        "repeated": "a study lists a sample twice",
        "conflict": "a row names several samples",
        "ambiguous": "an assay row fits several study rows",
        "unnamed": "assay without a name",
        "corrupt": "archive cannot be unpacked",
        "no_zip": "archive cannot be unpacked",
        "open": "quotes of a tab do not add up",
        "open_i": "quotes of a tab do not add up",
        "nameless": "a tab has no Sample Name column",
    }
    with pytest.raises(DataError, match="missing tab"):
        build_samples(*inputs(spark, bad=bad["no_study"]))


def test_archives_of_the_query_are_made_once(spark, monkeypatch):
    from assaylens.plans import ingest_queries

    given = []
    monkeypatch.setattr(ingest_queries, "build_samples", lambda archives, files: given.extend([archives, files]) or 1 / 0)
    with pytest.raises(ZeroDivisionError):
        ingest_queries.ingest_samples(spark, "/root/testdata/sf0.001")
    assert not any("MapInPandas" in f._jdf.queryExecution().toString() for f in given)


def test_rows_are_matched_once_and_documents_of_samples_are_not_exploded(spark, monkeypatch):
    from assaylens import ingest as ingesting
    from assaylens.operators import files, names, shape

    matches, exploded = [], []

    def counted(*args):
        matches.append(args)
        return names.best_match(*args)

    monkeypatch.setattr(ingesting, "best_match", counted)
    monkeypatch.setattr(shape, "best_match", counted)
    monkeypatch.setattr(files, "listed_items", lambda *args: exploded.append(args) or 1 / 0)
    commented = INVESTIGATION.replace("Study Title\tMice", "Study Title\tMice\nComment[Report]\tlisted.txt , other.txt")
    samples = build_samples(*inputs(spark, D=archive(), E=archive(i=commented)))
    found = {(r["accession"], r["sample_name"]): [f["filename"] for f in r["files"]] for r in samples.collect()}
    assert found == {
        ("D", "s.1"): ["pca.csv", "r1.fq", "x.zip"],
        ("D", "s.2"): ["pca.csv", "x.zip"],
        ("E", "s.1"): ["listed.txt", "pca.csv", "r1.fq", "x.zip"],
        ("E", "s.2"): ["listed.txt", "pca.csv", "x.zip"],
    }
    assert len(matches) == 1 and not exploded
    assert samples.columns == [*ingesting.IDS, "study_name", "attrs", "document", "files"]
