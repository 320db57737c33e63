import time

import pytest
from compare import compare, connect

from assaylens.plans import refresh_queries  # noqa: F401
from assaylens.plans.registry import QUERIES, SQL
from assaylens.streaming import keyed

SF = "/root/testdata/sf0.001"
LISTING = "accession string, filename string, ts bigint"


class Store:
    """Announces polls, runs the stream over them, and counts what is built."""

    def __init__(self, spark, tmp_path):
        self.spark, self.folder, self.root = spark, str(tmp_path / "in"), str(tmp_path / "store")
        self.number = 0
        self.bad = set()
        self.built = []

    def build(self, rows):
        names = {r.accession for r in rows.select("accession").distinct().collect()}
        self.built.append(names)
        bad = [(a, "quotes do not add up") for a in names & self.bad]
        return rows, self.spark.createDataFrame(bad, keyed.FAILURE_SCHEMA)

    def announce(self, unreachable=(), **datasets):
        rows = [(a, f"f{n}", ts) for a, ts in datasets.items() for n in range(2)]
        lost = self.spark.createDataFrame([(a,) for a in unreachable], "accession string")
        keyed.announce(self.spark.createDataFrame(rows, LISTING), self.folder, self.number, lost)
        self.number += 1

    def run(self, **options):
        self.built = []
        stream = keyed.start(self.spark, self.folder, self.root, self.build, **options)
        stream.awaitTermination()
        if stream.exception():
            raise stream.exception()
        return set().union(*self.built)

    def current(self):
        found = {(r.accession, r.ts) for r in keyed.read_store(self.spark, self.root).collect()}
        n = keyed.read_store(self.spark, self.root).count()
        assert n == 2 * len(found)
        return dict(found)

    def statuses(self):
        log = keyed.read_status(self.spark, self.root)
        last = log.agg({"batch_id": "max"}).head()[0]
        return {r.accession: r.status for r in log.where(log.batch_id == last).collect()}


@pytest.mark.parametrize("name", ["u9_keyed_refresh", "u9_keyed_failures"])
def test_queries(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), SQL[name]) is None


def test_only_what_changed_is_built(spark, tmp_path):
    store = Store(spark, tmp_path)
    store.announce(a=1, b=1, c=1)
    assert store.run() == {"a", "b", "c"} and store.current() == {"a": 1, "b": 1, "c": 1}
    store.announce(a=1, b=2, d=1)
    events = {(r.accession, r.kind) for r in spark.read.parquet(f"{store.folder}/events/poll-1").collect()}
    assert events == {("b", "live"), ("c", "absent"), ("d", "live")}
    assert store.run() == {"b", "d"} and store.current() == {"a": 1, "b": 2, "d": 1}
    assert store.statuses() == {"b": "updated", "c": "dropped", "d": "new"}
    where = {r.accession: r.snapshot for r in keyed.read_current(spark, store.root).collect()}
    assert where == {"a": 0, "b": 1, "d": 1}
    # nothing is new: nothing is done
    store.announce(a=1, b=2, d=1)
    assert store.run() == set() and store.current() == {"a": 1, "b": 2, "d": 1}
    # several polls at once count by the newest
    store.announce(a=1, b=3)
    store.announce(a=5, b=2, c=7)
    assert store.run() == {"a", "c"}
    assert store.current() == {"a": 5, "b": 2, "c": 7}
    keyed.fold(spark, store.root)
    assert store.current() == {"a": 5, "b": 2, "c": 7}
    store.announce(a=6, c=7)
    store.run()
    assert store.current() == {"a": 6, "c": 7}


def test_failures_are_tried_again(spark, tmp_path):
    store = Store(spark, tmp_path)
    store.bad = {"b"}
    store.announce(a=1, b=1)
    store.run()
    assert store.current() == {"a": 1} and store.statuses()["b"] == "failed"
    store.announce(a=1, b=1)  # no event; the failure itself is one
    assert store.run() == {"b"} and store.current() == {"a": 1}
    store.bad = set()
    assert store.run() == {"b"} and store.current() == {"a": 1, "b": 1}
    assert store.statuses() == {"b": "retried"}
    assert store.run() == set()
    # an update that fails loses the rows, as they are no longer those of the dataset
    store.bad = {"a"}
    store.announce(a=2, b=1)
    assert store.run() == {"a"} and store.current() == {"b": 1}
    store.announce(a=3, b=1)
    store.bad = set()
    assert store.run() == {"a"} and store.current() == {"a": 3, "b": 1}


def test_unreachable_datasets_keep_their_rows(spark, tmp_path):
    store = Store(spark, tmp_path)
    store.announce(a=1, b=1)
    store.run()
    store.announce(unreachable=("a", "x"), b=1)
    assert store.run() == set() and store.current() == {"a": 1, "b": 1}
    assert store.statuses() == {"a": "stale", "x": "failed"}
    store.announce(a=1, b=1, x=1)
    assert store.run() == {"x"} and store.statuses() == {"a": "fresh", "x": "new"}
    store.announce(unreachable=("a",), b=1, x=1)
    store.run()
    store.announce(a=2, b=1, x=1)
    assert store.run() == {"a"} and store.current() == {"a": 2, "b": 1, "x": 1}


def test_timers_try_again_and_remind(spark, tmp_path):
    store = Store(spark, tmp_path)
    store.bad = {"b"}
    store.announce(a=1, b=1)
    stream = keyed.start(spark, store.folder, store.root, store.build, retry_after=3_000, interval="500 milliseconds")
    log = lambda: keyed.read_status(spark, store.root).where("accession = 'a' AND status = 'stale'")
    end = time.time() + 150

    def wait(done):
        while not done():
            assert stream.exception() is None and time.time() < end
            time.sleep(0.5)

    try:
        wait(lambda: store.built)
        store.bad = set()
        wait(lambda: {"b"} in store.built)
        store.announce(unreachable=("a",), b=1)
        wait(lambda: log().count() >= 2)
    finally:
        stream.stop()
    assert store.current() == {"a": 1, "b": 1}
    with pytest.raises(ValueError):
        keyed.start(spark, store.folder, store.root, store.build, retry_after=1)


def test_a_batch_can_run_twice(spark, tmp_path):
    store = Store(spark, tmp_path)
    store.announce(a=1, b=1)
    calls = []

    def build(rows):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("the build failed")
        return rows

    good, store.build = store.build, build
    with pytest.raises(Exception, match="the build failed"):
        store.run()
    store.run()
    assert store.current() == {"a": 1, "b": 1}
    store.announce(a=1, b=1)
    store.build = good
    assert store.run() == set()


def test_files_do_not_grow_with_the_number_of_datasets(spark, tmp_path):
    store = Store(spark, tmp_path)
    store.announce(**{f"d{n}": n for n in range(1000)})
    assert len(store.run()) == 1000
    assert len(list((tmp_path / "store" / "data").glob("**/*.parquet"))) < 50
    assert store.current() == {f"d{n}": n for n in range(1000)}
