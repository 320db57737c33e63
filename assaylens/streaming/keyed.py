"""Continuous refresh by keyed state: a batch costs the datasets that changed.

Where ``refresh`` compares all of a snapshot with all of a manifest, here each dataset has
a state of its own in the state store: the fingerprint and snapshot of the rows it has, the
newest snapshot that told of it, and whether its last build failed. A poll announces what
is different from the poll before, as one event per dataset: it is live with another
fingerprint, absent, or could not be reached. The stream keeps the states and decides; a
micro-batch builds what is new, updated or to be tried again, and writes

* ``status/batch_id=N``: the class of each dataset with an event, and why some failed,
* ``data/batch_id=N``: the rows of the datasets that were built, sorted by accession, and
* ``changes/batch_id=N``: where the rows of each dataset with an event are now, written last.

A failed build is told to the state by an event of the kind ``failed``, so the dataset is
tried again: by the next batch, or ``retry_after`` milliseconds later, when its timer
expires. A dataset that could not be reached keeps its rows, and its timer reports it again
until it is back. Events say what is, not what to do, so reading one twice changes nothing,
and a snapshot need not be complete to be read. A batch that runs again replaces its own
folders; readers take the last change of each dataset.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from assaylens.operators.refresh import manifest
from assaylens.sources.store import read_datasets, write_sorted

EVENT_SCHEMA = "accession string, kind string, fingerprint string, snapshot bigint"
DECISION_SCHEMA = "accession string, class string, snapshot bigint"
CHANGE_SCHEMA = "accession string, snapshot bigint, data_batch bigint"
STATE_SCHEMA = "fingerprint string, snapshot bigint, seen bigint, condition string"
FAILURE_SCHEMA = "accession string, reason string"
LIVE, ABSENT, UNREACHABLE, FAILED = "live", "absent", "unreachable", "failed"
BUILT = ("new", "updated", "retried")
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Builder = Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]]


def _complete(spark: SparkSession, folder: str, key: str) -> list[int]:
    """Numbers n of the folders ``key=n`` that were written whole, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(path) if files.exists(path) else ()
    names = [status.getPath().getName() for status in found]
    whole = [n for n in names if n.startswith(f"{key}=") and files.exists(hadoop.Path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in whole)


# ---------------------------------------------------------------- announcing


def changed_datasets(now: DataFrame, before: DataFrame) -> DataFrame:
    """(accession, kind, fingerprint) of what differs between two polls of the same columns.

    What is in the first one only has become absent.
    """
    then = before.select("accession", F.col("kind").alias("_kind"), F.col("fingerprint").alias("_fingerprint"))
    both = now.join(then, "accession", "full")
    same = F.col("kind").eqNullSafe(F.col("_kind")) & F.col("fingerprint").eqNullSafe(F.col("_fingerprint"))
    return both.where(~same).select("accession", F.coalesce("kind", F.lit(ABSENT)).alias("kind"), "fingerprint")


def announce(listing: DataFrame, folder: str, number: int, unreachable: DataFrame | None = None) -> None:
    """Publish what a poll found: a listing (accession and file columns), and the accessions
    that could not be reached.

    Only datasets that differ from the poll before are published, with their rows. What the
    poll knew is written last; announcing it again after a failure replaces the same files.
    """
    spark = listing.sparkSession
    lost = spark.createDataFrame([], "accession string")
    if unreachable is not None:
        lost = unreachable.select("accession").distinct()
        listing = listing.join(lost, "accession", "left_anti")
    live = manifest(listing).select("accession", F.lit(LIVE).alias("kind"), "fingerprint")
    now = live.unionByName(lost.withColumns({"kind": F.lit(UNREACHABLE), "fingerprint": F.lit(None).cast("string")}))
    earlier = [n for n in _complete(spark, f"{folder}/known", "snapshot") if n < number]
    none = spark.createDataFrame([], "accession string, kind string, fingerprint string")
    before = spark.read.parquet(f"{folder}/known/snapshot={earlier[-1]}") if earlier else none
    known = f"{folder}/polled/snapshot={number}"
    now.write.mode("overwrite").parquet(known)
    now = spark.read.parquet(known)
    events = changed_datasets(now, before).withColumn("snapshot", F.lit(number).cast("bigint"))
    rows = listing.join(events.where(F.col("kind") == LIVE).select("accession"), "accession", "left_semi")
    rows.write.mode("overwrite").parquet(f"{folder}/listings/snapshot={number}")
    events.write.mode("overwrite").parquet(f"{folder}/events/poll-{number}")
    now.write.mode("overwrite").parquet(f"{folder}/known/snapshot={number}")


# ---------------------------------------------------------------- deciding


class DatasetProcessor(StatefulProcessor):
    """Decides what becomes of a dataset, from its state and the events that tell of it."""

    def __init__(self, retry_after: int) -> None:
        self._retry_after = retry_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("dataset", STATE_SCHEMA)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self._state.get()
        fingerprint, snapshot, seen, condition = held or (None, None, -1, ABSENT)
        newest = None
        for event in rows:
            if event.kind == FAILED:
                # of a build that is not the last one it says nothing
                if condition != ABSENT and event.snapshot == snapshot:
                    condition = FAILED
            elif event.snapshot >= seen and (newest is None or event.snapshot >= newest.snapshot):
                newest = event
        if newest is None:
            decision = self._failed(timerValues) if condition == FAILED else None
        else:
            seen = newest.snapshot
            if newest.kind == ABSENT:
                self._forget_timers()
                self._state.clear()
                return self._decided(key, "dropped" if held else None, seen)
            if newest.kind == UNREACHABLE:
                decision = "stale" if snapshot is not None and condition != FAILED else "failed"
                condition = UNREACHABLE if decision == "stale" else condition
                self._remind(timerValues)
            else:
                self._forget_timers()
                if snapshot is None:
                    decision = "new"
                elif condition == FAILED:
                    decision = "retried"
                else:
                    decision = "fresh" if fingerprint == newest.fingerprint else "updated"
                condition = LIVE
                if decision != "fresh":
                    fingerprint, snapshot = newest.fingerprint, seen
        if decision == "retried":
            condition = LIVE
        self._state.update((fingerprint, snapshot, int(seen), condition))
        return self._decided(key, decision, snapshot if decision in BUILT else seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self._state.get()
        if held is None:
            return self._decided(key, None, None)
        fingerprint, snapshot, seen, condition = held
        if condition == FAILED:
            self._state.update((fingerprint, snapshot, seen, LIVE))
            return self._decided(key, "retried", snapshot)
        if condition == UNREACHABLE:
            self._remind(timerValues)
            return self._decided(key, "stale", seen)
        return self._decided(key, None, None)

    def close(self) -> None:
        pass

    def _failed(self, timer_values) -> str | None:
        """What to do about a build that failed: try again, at once or when a timer expires."""
        if not self._retry_after:
            return "retried"
        self._remind(timer_values)
        return None

    def _remind(self, timer_values) -> None:
        if self._retry_after:
            self._forget_timers()
            self._handle.registerTimer(timer_values.getCurrentProcessingTimeInMs() + self._retry_after)

    def _forget_timers(self) -> None:
        if self._retry_after:
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)

    @staticmethod
    def _decided(key, decision: str | None, snapshot: int | None) -> Iterator[Row]:
        if decision is not None:
            yield Row(**{"accession": key[0], "class": decision, "snapshot": int(snapshot)})


# ---------------------------------------------------------------- applying


def apply_decisions(decisions: DataFrame, batch_id: int, folder: str, root: str, build: Builder) -> None:
    """Build what a batch decided to build, and write where the rows of its datasets are."""
    spark = decisions.sparkSession
    # written once, for the states must not be read and written again by each use
    path = f"{root}/decisions"
    decisions.write.mode("overwrite").parquet(path)
    decisions = spark.read.schema(DECISION_SCHEMA).parquet(path)
    if decisions.isEmpty():
        return
    wanted = decisions.where(F.col("class").isin(*BUILT)).select("accession", "snapshot")
    polls = [r.snapshot for r in wanted.select("snapshot").distinct().collect()]
    if polls:
        listed = spark.read.parquet(f"{folder}/listings").where(F.col("snapshot").isin(polls))
        listed = listed.withColumn("snapshot", F.col("snapshot").cast("bigint"))
        built = build(listed.join(wanted, ["accession", "snapshot"], "left_semi").drop("snapshot"))
        rows, failures = built if isinstance(built, tuple) else (built, spark.createDataFrame([], FAILURE_SCHEMA))
    else:
        rows, failures = None, spark.createDataFrame([], FAILURE_SCHEMA)
    reasons = failures.groupBy("accession").agg(F.min("reason").alias("error"))
    lost = F.when(F.col("class").isin("stale", "failed"), "could not be reached")
    status = decisions.join(reasons, "accession", "left").select(
        "accession",
        F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("class")).alias("status"),
        F.coalesce("error", lost).alias("error"),
        "class",
        "snapshot",
    )
    path = f"{root}/status/batch_id={batch_id}"
    status.write.mode("overwrite").parquet(path)
    status = spark.read.parquet(path)
    broken = status.where(F.col("class").isin(*BUILT) & (F.col("status") == "failed"))
    if rows is not None:
        sound = rows.join(broken.select("accession"), "accession", "left_anti")
        write_sorted(sound, f"{root}/data/batch_id={batch_id}")
        told = broken.select(
            "accession", F.lit(FAILED).alias("kind"), F.lit(None).cast("string").alias("fingerprint"), "snapshot"
        )
        told.write.mode("overwrite").parquet(f"{folder}/events/batch-{batch_id}")
    # fresh, stale and unreached datasets keep the rows they have
    there = (F.col("class") != "dropped") & (F.col("status") != "failed")
    moved = status.where(F.col("class").isin(*BUILT, "dropped")).select(
        "accession", "snapshot", F.when(there, F.lit(batch_id)).cast("bigint").alias("data_batch")
    )
    moved.write.mode("overwrite").parquet(f"{root}/changes/batch_id={batch_id}")


def start(
    spark: SparkSession,
    folder: str,
    root: str,
    build: Builder,
    retry_after: int = 0,
    interval: str | None = None,
) -> StreamingQuery:
    """Start the refresh over what is announced in a folder.

    Without ``interval`` the stream takes what is there and ends. ``retry_after`` (in
    milliseconds) sets when failed builds are tried again, and needs an interval; 0 means
    with the next batch, and no reminders of datasets that cannot be reached. Whether there
    are timers is settled when a store is begun.
    """
    if retry_after and not interval:
        raise ValueError("timers need a stream that goes on: give an interval")
    events = (
        spark.readStream.schema(EVENT_SCHEMA).option("recursiveFileLookup", "true").parquet(f"{folder}/events")
    )
    # a stream with timers always has a next batch, so one that is to end has none
    decisions = events.groupBy("accession").transformWithState(
        DatasetProcessor(retry_after),
        DECISION_SCHEMA,
        outputMode="append",
        timeMode="ProcessingTime" if retry_after else "None",
    )
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    writer = (
        decisions.writeStream.foreachBatch(lambda df, n: apply_decisions(df, n, folder, root, build))
        .option("checkpointLocation", f"{root}/_stream")
        .outputMode("append")
        .trigger(**trigger)
    )
    # several states and timers to a key need this store; the stream takes its settings as it starts
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return writer.start()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


# ---------------------------------------------------------------- reading


def _changes(spark: SparkSession, root: str) -> DataFrame:
    """The last change of each dataset, of those whose rows are somewhere."""
    folded = _complete(spark, f"{root}/folded", "batch_id")
    base = folded[-1] if folded else -1
    later = [n for n in _complete(spark, f"{root}/changes", "batch_id") if n > base]
    paths = [f"{root}/changes/batch_id={n}" for n in later] + [f"{root}/folded/batch_id={n}" for n in folded[-1:]]
    if not paths:
        return spark.createDataFrame([], CHANGE_SCHEMA)
    found = spark.read.schema(CHANGE_SCHEMA).parquet(*paths)
    batch = F.regexp_extract("_metadata.file_path", r"batch_id=(\d+)/[^/]*$", 1).cast("bigint")
    last = found.withColumn("batch", batch).groupBy("accession").agg(F.max_by(F.struct("snapshot", "data_batch"), "batch").alias("c"))
    return last.select("accession", "c.*").where("data_batch IS NOT NULL")


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """(accession, snapshot, data_batch): the datasets that have rows, and of which poll."""
    return _changes(spark, root)


def fold(spark: SparkSession, root: str) -> None:
    """Write the changes so far as one; readers then read that and what came later."""
    done = _complete(spark, f"{root}/changes", "batch_id")
    if done:
        _changes(spark, root).write.mode("overwrite").parquet(f"{root}/folded/batch_id={done[-1]}")


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """The current rows of all datasets; only batches that live datasets are in are read."""
    current = read_current(spark, root).select("accession", F.col("data_batch").alias("batch_id"))
    rows = read_datasets(spark, f"{root}/data").withColumn("batch_id", F.col("batch_id").cast("bigint"))
    rows = rows.select("accession", *[c for c in rows.columns if c != "accession"])
    return rows.join(current, ["accession", "batch_id"], "left_semi").drop("batch_id")


def read_status(spark: SparkSession, root: str) -> DataFrame:
    """(batch_id, accession, status, error) of all events, batch by batch."""
    log = spark.read.parquet(f"{root}/status").withColumn("batch_id", F.col("batch_id").cast("bigint"))
    return log.select("batch_id", "accession", "status", "error")
