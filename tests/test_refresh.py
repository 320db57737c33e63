import pytest

from assaylens.operators import refresh
from assaylens.streaming import refresh as streaming

LISTING = "accession string, filename string, ts bigint"


def manifest(spark, **datasets):
    return spark.createDataFrame(list(datasets.items()), "accession string, fingerprint string")


def as_dict(df, key="accession", value="class"):
    return {r[key]: r[value] for r in df.collect()}


def test_classes(spark):
    cached = manifest(spark, a="1", b="1", c="1", d="1")
    live = manifest(spark, a="1", b="2", e="1")
    lost = spark.createDataFrame([("d",), ("f",)], "accession string")
    assert as_dict(refresh.classify(cached, live, lost)) == {
        "a": "fresh", "b": "updated", "c": "dropped", "d": "stale", "e": "new", "f": "failed",
    }
    assert as_dict(refresh.membership(cached, live), value="membership") == {
        "a": "common", "b": "common", "c": "dropped", "d": "dropped", "e": "new",
    }
    counts = as_dict(refresh.class_counts(refresh.classify(cached, live)), "class", "n_datasets")
    assert counts == {"fresh": 1, "updated": 1, "dropped": 2, "new": 1}


def test_replacing_datasets(spark):
    schema = "accession string, row string"
    stored = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old"), ("d", "old"), ("x", "old")], schema)
    rows = spark.createDataFrame([("a", "new"), ("b", "new"), ("e", "new"), ("x", "new")], schema)
    classes = refresh.classify(
        manifest(spark, a="1", b="1", c="1", d="1", x="1"),
        manifest(spark, a="1", b="2", e="1", x="2"),
        spark.createDataFrame([("d",)], "accession string"),
    )
    failed = spark.createDataFrame([("x",)], "accession string")
    out = refresh.replace_datasets(stored, rows, classes, failed)
    expected = [("a", "old"), ("b", "new"), ("d", "old"), ("e", "new")]
    assert sorted(map(tuple, out.collect())) == expected
    again = refresh.replace_datasets(out, rows, classes, failed)
    assert sorted(map(tuple, again.collect())) == expected


def test_upsert_replaces_by_key(spark):
    schema = "k string, v string, ts bigint"
    stored = spark.createDataFrame([("a", "1", 9), ("b", "1", 1)], schema)
    updates = spark.createDataFrame([("a", "2", 5), ("a", "3", 6), ("c", "4", 1)], schema)
    out = refresh.upsert(stored, updates, ["k"], "ts")
    assert sorted(map(tuple, out.collect())) == [("a", "3", 6), ("b", "1", 1), ("c", "4", 1)]
    assert out.columns == stored.columns


def test_a_dropped_dataset_loses_its_log(spark):
    log = spark.createDataFrame(
        [("a", "updated", 1), ("a", "fresh", 2), ("a", "dropped", 3), ("a", "updated", 3), ("a", "fresh", 5),
         ("a", "fresh", 4), ("b", "fresh", 1)],
        "accession string, status string, report_ts bigint",
    )
    out = refresh.current_status(log, ["accession", "status"])
    assert sorted(map(tuple, out.collect())) == [
        ("a", "dropped", 3), ("a", "fresh", 5), ("a", "updated", 3), ("b", "fresh", 1),
    ]
    view = refresh.status_view(log.union(log))
    assert view.count() == 7 and "kwargs" in view.columns and "info" not in view.columns


def run(spark, path, root, build=lambda rows: rows):
    stream = streaming.start_refresh(spark, path, root, build)
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


FIRST = [("a", "f1", 1), ("b", "f1", 1), ("c", "f1", 1)]
SECOND = [("a", "f1", 1), ("b", "f1", 2), ("b", "f2", 2), ("d", "f1", 1)]


def test_stream_equals_batch(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "store")
    streaming.publish_snapshot(spark.createDataFrame(FIRST, LISTING), path, 0)
    run(spark, path, root)
    assert sorted(map(tuple, streaming.read_store(spark, root).collect())) == sorted(FIRST)
    streaming.publish_snapshot(spark.createDataFrame(SECOND, LISTING), path, 1)
    run(spark, path, root)
    assert as_dict(streaming.read_report(spark, root, 1)) == {
        "a": "fresh", "b": "updated", "c": "dropped", "d": "new",
    }
    placed = {r["accession"]: r["data_batch"] for r in streaming.read_manifest(spark, root).collect()}
    assert placed == {"a": 0, "b": 1, "d": 1}
    old, new = (spark.createDataFrame(rows, LISTING) for rows in (FIRST, SECOND))
    classes = refresh.classify(refresh.manifest(old), refresh.manifest(new))
    batch = refresh.replace_datasets(old, new, classes)
    assert sorted(map(tuple, streaming.read_store(spark, root).collect())) == sorted(map(tuple, batch.collect()))


def test_failures_and_unreachable_datasets(spark, tmp_path):
    root = str(tmp_path / "store")
    reason = spark.createDataFrame([("b", "quotes do not add up")], "accession string, reason string")

    def build(rows):
        bad = reason.join(rows.select("accession").distinct(), "accession", "left_semi")
        return rows, bad

    listing = spark.createDataFrame(FIRST, LISTING)
    lost = spark.createDataFrame([("x",)], "accession string")
    streaming.refresh_store(listing, 0, root, build, lost)
    assert {r["accession"] for r in streaming.read_store(spark, root).collect()} == {"a", "c"}
    second = spark.createDataFrame(SECOND, LISTING)
    for _ in range(2):  # doing a batch again changes nothing
        streaming.refresh_store(second, 1, root, build, spark.createDataFrame([("a",), ("y",)], "accession string"))
        assert sorted(map(tuple, streaming.read_store(spark, root).collect())) == [("a", "f1", 1), ("d", "f1", 1)]
        log = streaming.read_status(spark, root).filter("report_ts = 1").collect()
        assert {(r["accession"], r["status"], r["error"]) for r in log} == {
            ("a", "stale", "could not be reached"), ("b", "failed", "quotes do not add up"),
            ("c", "dropped", None), ("d", "new", None), ("y", "failed", "could not be reached"),
        }
    now = refresh.current_status(streaming.read_status(spark, root), ["accession", "status"]).collect()
    assert {(r["accession"], r["status"]) for r in now if r["accession"] == "b"} == {("b", "failed")}
    # what failed is tried again, and the store can be written anew as one batch
    streaming.refresh_store(second, 2, root, lambda rows: rows)
    assert as_dict(streaming.read_report(spark, root, 2)) == {"a": "fresh", "b": "new", "d": "fresh"}
    before = sorted(map(tuple, streaming.read_store(spark, root).collect()))
    streaming.compact(spark, root, 3)
    assert sorted(map(tuple, streaming.read_store(spark, root).collect())) == before == sorted(SECOND)
    assert {r["data_batch"] for r in streaming.read_manifest(spark, root).collect()} == {3}


def test_a_batch_can_run_twice(spark, tmp_path):
    root = str(tmp_path / "store")
    frames = [spark.createDataFrame(rows, LISTING) for rows in (FIRST, SECOND)]
    failures = iter([True, False])

    def build(rows):
        if next(failures):
            raise RuntimeError("the build failed")
        return rows

    streaming.refresh_store(frames[0], 0, root, lambda rows: rows)
    with pytest.raises(RuntimeError):
        streaming.refresh_store(frames[1], 1, root, build)
    # the failed batch left no manifest: the store is as it was
    assert sorted(map(tuple, streaming.read_store(spark, root).collect())) == sorted(FIRST)
    for _ in range(2):
        streaming.refresh_store(frames[1], 1, root, lambda rows: rows)
        assert sorted(map(tuple, streaming.read_store(spark, root).collect())) == sorted(SECOND)
        assert as_dict(streaming.read_report(spark, root, 1))["a"] == "fresh"


def test_files_do_not_grow_with_the_number_of_datasets(spark, tmp_path):
    root = tmp_path / "store"
    listing = spark.range(3000).selectExpr("CAST(id AS STRING) AS accession", "'f' AS filename", "id AS ts")
    streaming.refresh_store(listing, 0, str(root), lambda rows: rows)
    assert len(list(root.glob("data/**/*.parquet"))) < 50
    stored = streaming.read_store(spark, str(root))
    assert dict(stored.dtypes)["accession"] == "string" and stored.count() == 3000
