import io
import random
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from assaylens.ingest import ingest, ingest_folder
from assaylens.plans.ingest_queries import _INVESTIGATION, _archives_of
from assaylens.plans.registry import QUERIES, SQL
from assaylens.sources import archives, isa

SF = "/root/testdata/sf0.001"


def write(folder, name, members, method=zipfile.ZIP_DEFLATED):
    folder.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(folder / name, "w", method) as archive:
        for member, text in members.items():
            archive.writestr(member, text)


def rows(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))


def odd_tab(seed, n):
    draw = random.Random(seed)
    cells = ["x", "", "é日本", '"a\tb"', '"two\nlines"', '"say ""hi"""', '"# no comment\n"', "5' tall", "long " * 30]
    lines = []
    for number in range(n):
        lines.append("\t".join([f"smp{number}", *draw.choices(cells, k=3)]))
        lines += draw.choices([[], ["# a comment"], [""], ["# with \" a quote"]], weights=[8, 1, 1, 1])[0]
    return draw.choice(["\n", "\r\n"]).join(["Sample Name\tA\tB\tC", *lines])


def test_query(spark):
    assert compare(QUERIES["s4_large_archive"](spark, SF), connect(SF), SQL["s4_large_archive"]) is None


@pytest.mark.parametrize("range_bytes", [50, 333, 5_000, 1 << 24])
def test_ranges_are_the_lines_of_the_archive(spark, tmp_path, range_bytes):
    for number in range(3):
        tabs = {f"x/s_{k}.txt": odd_tab(10 * number + k, 40 * k) for k in range(4)}
        write(tmp_path / str(number), f"DS-{number}_metadata_v1.zip", {**tabs, "x/i_all.txt": _INVESTIGATION, "no.md": "-"})
    whole = isa.archive_lines(isa.read_archives(spark, f"{tmp_path}/*"))
    assert rows(archives.scan_archives(spark, str(tmp_path), range_bytes)) == rows(whole)
    assert rows(archives.scan_archives(spark, f"file:{tmp_path}", range_bytes)) == rows(whole)


def test_one_archive_is_read_by_many_tasks(spark, tmp_path):
    text = "Sample Name\tValue\n" + "".join(f"s{n}\tv{n}\n" for n in range(30_000))
    write(tmp_path, "big.zip", {"s_all.txt": text}, zipfile.ZIP_STORED)
    for number in range(20):
        write(tmp_path, f"small{number}.zip", {"s_all.txt": "Sample Name\nx\n"})
    lines = archives.scan_archives(spark, str(tmp_path), 50_000).withColumn("task", F.spark_partition_id())
    big = lines.where("accession = 'big'")
    per_task = [r["count"] for r in big.groupBy("task").count().collect()]
    assert len(per_task) >= 7 and max(per_task) < 2 * min(sorted(per_task)[1:])
    assert big.count() == 30_001 and big.select("line_no").distinct().count() == 30_001
    # the small ones share a task
    assert lines.where("accession <> 'big'").select("task").distinct().count() <= 2


def test_ranges_of_a_member_are_bounded():
    info = zipfile.ZipInfo("s_x.txt")
    info.file_size = 10**12
    ranges = archives.member_ranges("p", "a", info, archives.RANGE_BYTES)
    assert len(ranges) == archives.MOST_RANGES and ranges[-1].stop is None
    assert all(a.stop == b.start for a, b in zip(ranges, ranges[1:]))


def test_broken_archives_fail_alone(spark, tmp_path):
    write(tmp_path, "good.zip", {"s_a.txt": "Sample Name\nx\n"})
    write(tmp_path, "quotes.zip", {"s_a.txt": 'Sample Name\n"x\n' + "y\n" * 400})
    write(tmp_path, "none.zip", {"readme.md": "x"})
    (tmp_path / "cut.zip").write_bytes((tmp_path / "good.zip").read_bytes()[:40])
    data = bytearray((tmp_path / "good.zip").read_bytes())
    data[data.index(b"s_a.txt") + 9] ^= 0xFF
    (tmp_path / "flipped.zip").write_bytes(data)
    lines = archives.scan_archives(spark, str(tmp_path), 100)
    reasons = {(r.accession, r.reason) for r in isa.broken_archives(lines).collect()}
    assert reasons == {
        ("quotes", "quotes of a tab do not add up"), ("none", "archive has no tabs"),
        ("cut", "archive cannot be unpacked"), ("flipped", "archive cannot be unpacked"),
    }
    assert [r.cells for r in lines.where("accession = 'good'").orderBy("line_no").collect()] == [["Sample Name"], ["x"]]


def test_an_empty_folder(spark, tmp_path):
    assert archives.scan_archives(spark, str(tmp_path)).count() == 0


def test_writing_and_reading_back(spark, tmp_path):
    cells = [["a", None, ""], [""], ["#not a comment", "x"], ['"', "tab\there"], ["two\nlines"], ["é日本"], [None]]
    made = [("A", "s", "t", n, c) for n, c in enumerate(cells)] + [("A", "a", "t", 0, ["q"]), ("B", "s", "t", 5, ["z"])]
    frame = spark.createDataFrame(made, isa.LINE_SCHEMA).repartition(4)
    for _ in range(2):  # written again, the archives are the same
        done = archives.write_archives(frame, f"{tmp_path}/out")
        assert {(r.accession, r.n_lines) for r in done.collect()} == {("A", 8), ("B", 1)}
        back = {(r[0], r[1], r[3]): r[4] for r in archives.scan_archives(spark, f"{tmp_path}/out", 10).collect()}
        assert back == {
            **{("A", "s", n): ["" if x is None else x for x in c] for n, c in enumerate(cells)},
            ("A", "a", 0): ["q"], ("B", "s", 0): ["z"],
        }
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["A.zip", "B.zip"]


def test_ingest_of_a_folder_equals_that_of_contents(spark, tmp_path):
    study = "Source Name\tSample Name\tCharacteristics[Price]\n" + "".join(f"r{n}\ts{n}\t{n}\n" for n in range(200))
    assay = "Sample Name\tParameter Value[status]\n" + "".join(f"s{n}\tF\n" for n in range(200))
    write(tmp_path, "good.zip", {"i_all.txt": _INVESTIGATION, "s_first.txt": study, "a_first.txt": assay})
    write(tmp_path, "bare.zip", {"i_all.txt": _INVESTIGATION})
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    files = spark.createDataFrame(
        [(a, "ISA.zip", "isa", True, None) for a in ("good", "bare", "bad")],
        "accession string, filename string, datatype string, internal boolean, condition string",
    )
    found = ingest_folder(spark, str(tmp_path), files, range_bytes=500)
    known = ingest(isa.read_archives(spark, str(tmp_path)), files)
    for ours, theirs in zip(found, known):
        assert rows(ours) == rows(theirs)
    assert found[0].count() == 200 and {r.accession for r in found[1].collect()} == {"bare", "bad"}


def test_member_of_zip_contents_is_unpacked_as_it_is_read(tmp_path):
    """A range near the start of a member does not read what is behind it."""
    read = []

    class Lines(io.StringIO):
        def __next__(self):
            read.append(1)
            return super().__next__()

    found = list(archives.records(Lines("a\tb\n" * 1000), 0, 40))
    assert [n for n, _ in found] == list(range(10)) and len(read) <= 12


def test_batches_of_long_cells_are_bounded():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("s_x.txt", "Sample Name\n" + "m" * 400_000 + "\n")
    frame = pd.DataFrame({"accession": [str(n) for n in range(40)], "content": [out.getvalue()] * 40})
    found = list(isa._unzip(iter([frame])))
    assert sum(map(len, found)) == 80
    assert max(sum(len(c) for cells in f["cells"] for c in cells) for f in found) < 5 << 20
    keys = pd.DataFrame({"accession": ["x"] * 600, "key": range(600)})
    made = list(_archives_of(iter([keys])))
    assert sum(map(len, made)) == 600 and max(map(len, made)) <= 50


def test_a_large_member_is_unpacked_once(spark, tmp_path):
    """A member of many ranges is one partition, whose blocks are dealt by range; the old ranges
    each unpacked it from its start."""
    text = "Sample Name\tValue\n" + "".join(f'"s\n{n}"\tv{n}\n' for n in range(3_000))
    write(tmp_path, "big.zip", {"s_all.txt": text, "a_all.txt": "Sample Name\nx\n"})
    reader = archives.ArchiveReader({"path": str(tmp_path), "rangeBytes": "1000", "members": "large"})
    (partition,) = reader.partitions()
    found = [r for batch in reader.read(partition) for r in batch.to_pylist()]
    assert "".join(r["lines"] for r in found) == text
    assert found[0]["slot"] == 0 and len({r["slot"] for r in found}) > 20
    lines = archives.scan_archives(spark, str(tmp_path), 1_000).where("kind = 's'")
    assert [r.line_no for r in lines.orderBy("line_no").collect()] == list(range(3_001))


def test_one_archive_is_written_by_many_tasks(spark, tmp_path):
    made = spark.range(20_000).select(
        F.lit("A").alias("accession"), F.lit("s").alias("kind"), F.lit("t").alias("tab"), F.col("id").alias("line_no"),
        F.array(F.concat(F.lit("row\n"), "id"), F.col("id").cast("string")).alias("cells"),
    )
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        archives.write_archives(made, f"{tmp_path}/out")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    with zipfile.ZipFile(tmp_path / "out" / "A.zip") as archive:
        assert archive.testzip() is None
        # each part was packed on its own
        assert archive.read("s_t.txt").decode() == "".join(f'"row\n{n}"\t{n}\n' for n in range(20_000))
        packed = (tmp_path / "out" / "A.zip").read_bytes()
    assert packed.count(b"\x00\x00\xff\xff") >= 4
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["A.zip"]


def test_checksum_of_parts():
    texts = [b"", b"one", b"x" * 3_000_000, b"two"]
    crc = 0
    for text in texts:
        crc = archives._joined_crc(crc, zlib.crc32(text), len(text))
    assert crc == zlib.crc32(b"".join(texts))


def test_texts_of_a_batch_are_those_of_its_lines(monkeypatch):
    rows = [
        ["a", "b"], ["a", None, ""], [None], [""], [], ["", ""], ['say "x"', "y"], ["two\nlines"], ["cr\r", "é"],
        ["#", "a"], ["a", "#b"], ["a#", "b"], ["tab\tin", "c"], ["\t"], ["x" * 5000, "ü"], ["last"],
    ]
    cells = pa.array([["cut off"], *rows, ["cut off"]], pa.list_(pa.string())).slice(1, len(rows))
    assert archives._texts(cells).to_pylist() == [archives._line(r) for r in rows]
    assert archives._texts(cells.slice(0, 0)).to_pylist() == []
    # most lines need no step of their own
    looked = []
    monkeypatch.setattr(archives, "_line", lambda row: looked.append(row) or "")
    plain = pa.array([["src", str(k), None] for k in range(1000)], pa.list_(pa.string()))
    assert archives._texts(plain)[7].as_py() == "src\t7\t\n" and not looked
