"""Continuous refresh: a stream of file listings keeps a dataset store current.

A poll of the repository publishes a snapshot: the listing of all that is live and
the datasets that could not be reached, written by all tasks, and then one marker
row that names it. The stream reads markers, so it never sees half a snapshot. A
micro-batch compares the newest snapshot with the manifest, rebuilds the datasets
that are new or changed, and writes

* ``data/batch_id=N``: the rows of the rebuilt datasets, sorted by accession,
* ``report/batch_id=N``: the class of every dataset as the listings tell it,
* ``status/batch_id=N``: what became of every dataset, and why some failed,
* ``manifest/batch_id=N``: accession, fingerprint and the batch that holds its rows, and
* ``last``: the number of the last complete batch.

A dataset that cannot be built fails alone: it has no rows and is not in the
manifest, so the next snapshot tries it again. One that cannot be reached keeps the
rows it has. A batch only ever writes its own folders and reads those of earlier
batches, its manifest comes after its data and the pointer last. Running a batch
again after a failure therefore writes the same things once more, and readers see
the last complete manifest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assaylens.operators.refresh import classify, manifest
from assaylens.sources.store import read_datasets, write_sorted

MANIFEST_SCHEMA = "accession string, fingerprint string, data_batch bigint"
MARKER_SCHEMA = "snapshot bigint, path string, unreachable string"
FAILURE_SCHEMA = "accession string, reason string"
# rows of datasets, or rows and (accession, reason) of those that failed
Built = DataFrame | tuple[DataFrame, DataFrame]
Builder = Callable[[DataFrame], Built]


def _complete_batches(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches with a complete manifest."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    done = []
    for status in files.listStatus(path) if files.exists(path) else ():
        name = status.getPath().getName()
        marker = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("batch_id=") and files.exists(marker):
            done.append(int(name.split("=")[1]))
    return done


def _latest_batch(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    """Number of the last complete batch; the one before it while that is done again.

    The pointer tells it. Only where a crash has left none, the manifests are listed.
    """
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/last/_SUCCESS")
    if marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        row = spark.read.schema("batch bigint, previous bigint").parquet(f"{root}/last").first()
        redone = before is not None and row["batch"] >= before
        return row["previous"] if redone else row["batch"]
    return max((n for n in _complete_batches(spark, root) if before is None or n < before), default=None)


def read_manifest(spark: SparkSession, root: str, before: int | None = None) -> DataFrame:
    """(accession, fingerprint, data_batch) as of the last complete batch."""
    batch = _latest_batch(spark, root, before)
    if batch is None:
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.parquet(f"{root}/manifest/batch_id={batch}").select(
        "accession", "fingerprint", "data_batch"
    )


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """The current rows of all datasets; only batches that live datasets are in are read."""
    current = read_manifest(spark, root).select("accession", F.col("data_batch").alias("batch_id"))
    rows = read_datasets(spark, f"{root}/data")
    rows = rows.select("accession", *[c for c in rows.columns if c != "accession"])
    return rows.withColumn("batch_id", F.col("batch_id").cast("bigint")).join(
        current, ["accession", "batch_id"], "left_semi"
    ).drop("batch_id")


def read_report(spark: SparkSession, root: str, batch_id: int | None = None) -> DataFrame:
    """(batch_id, accession, class) of one batch or of all."""
    report = spark.read.parquet(f"{root}/report").withColumn("batch_id", F.col("batch_id").cast("bigint"))
    return report if batch_id is None else report.filter(F.col("batch_id") == batch_id)


def read_status(spark: SparkSession, root: str) -> DataFrame:
    """The status log of all batches: (report_ts, accession, status, error, report_type).

    Reports are numbered by their batch, so that a batch done again reports the same.
    """
    log = spark.read.parquet(f"{root}/status").withColumn("batch_id", F.col("batch_id").cast("bigint"))
    return log.withColumnRenamed("batch_id", "report_ts").withColumn("report_type", F.lit("dataset status"))


def publish_snapshot(
    listing: DataFrame, folder: str, number: int, unreachable: DataFrame | None = None
) -> None:
    """Write a listing (accession and file columns), the accessions that could not be
    reached, and, once both are complete, the marker."""
    path, lost = f"{folder}/listings/snapshot={number}", f"{folder}/unreachable/snapshot={number}"
    spark = listing.sparkSession
    listing.write.mode("overwrite").parquet(path)
    none = spark.createDataFrame([], "accession string")
    (none if unreachable is None else unreachable.select("accession")).write.mode("overwrite").parquet(lost)
    marker = spark.createDataFrame([(number, path, lost)], MARKER_SCHEMA)
    marker.coalesce(1).write.mode("append").parquet(f"{folder}/markers")


def refresh_batch(markers: DataFrame, batch_id: int, root: str, build: Builder) -> None:
    """Bring the store in line with the newest snapshot that a batch of markers names."""
    newest = markers.orderBy(F.col("snapshot").desc()).first()
    if newest is not None:
        spark = markers.sparkSession
        live, lost = spark.read.parquet(newest["path"]), spark.read.parquet(newest["unreachable"])
        refresh_store(live, batch_id, root, build, lost)


def refresh_store(
    live_rows: DataFrame, batch_id: int, root: str, build: Builder, unreachable: DataFrame | None = None
) -> None:
    """Bring the store in line with the listing of what is live."""
    spark = live_rows.sparkSession
    earlier = _latest_batch(spark, root, before=batch_id)
    cached = read_manifest(spark, root, before=batch_id)
    if unreachable is not None:
        live_rows = live_rows.join(unreachable.select("accession").distinct(), "accession", "left_anti")
    classes = classify(cached.select("accession", "fingerprint"), manifest(live_rows), unreachable)
    report = f"{root}/report/batch_id={batch_id}"
    classes.write.mode("overwrite").parquet(report)
    classes = spark.read.schema(classes.schema).parquet(report)

    wanted = classes.filter(F.col("class").isin("new", "updated")).select("accession")
    built = build(live_rows.join(wanted, "accession", "left_semi"))
    rows, failures = built if isinstance(built, tuple) else (built, spark.createDataFrame([], FAILURE_SCHEMA))
    status = f"{root}/status/batch_id={batch_id}"
    _statuses(classes, failures).write.mode("overwrite").parquet(status)
    broken = spark.read.parquet(status).filter(F.col("status") == "failed").select("accession")
    # a batch done again finds what it wrote before: the same rows, replaced as a whole
    write_sorted(rows.join(broken, "accession", "left_anti"), f"{root}/data/batch_id={batch_id}")
    current = (
        classes.filter(F.col("class") != "dropped")
        .join(broken, "accession", "left_anti")
        .join(cached.select("accession", "data_batch"), "accession", "left")
        .select(
            "accession",
            "fingerprint",
            F.when(F.col("class").isin("fresh", "stale"), F.col("data_batch"))
            .otherwise(F.lit(batch_id).cast("bigint"))
            .alias("data_batch"),
        )
    )
    current.write.mode("overwrite").parquet(f"{root}/manifest/batch_id={batch_id}")
    pointer = spark.createDataFrame([(batch_id, earlier)], "batch bigint, previous bigint")
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{root}/last")


def _statuses(classes: DataFrame, failures: DataFrame) -> DataFrame:
    """(accession, status, error): the class, or that and why a dataset failed."""
    reasons = failures.groupBy("accession").agg(F.min("reason").alias("error"))
    lost = F.when(F.col("class").isin("stale", "failed"), "could not be reached")
    return classes.join(reasons, "accession", "left").select(
        "accession",
        F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("class")).alias("status"),
        F.coalesce("error", lost).alias("error"),
    )


def compact(spark: SparkSession, root: str, batch_id: int) -> None:
    """Write the live rows of all batches as the rows of one, numbered like a batch.

    Folders of earlier batches are then read by nobody and can be deleted. Run it
    between streams, with a number above the last batch's.
    """
    earlier = _latest_batch(spark, root, before=batch_id)
    live = read_manifest(spark, root, before=batch_id)
    write_sorted(read_store(spark, root), f"{root}/data/batch_id={batch_id}")
    moved = live.withColumn("data_batch", F.lit(batch_id).cast("bigint"))
    moved.write.mode("overwrite").parquet(f"{root}/manifest/batch_id={batch_id}")
    pointer = spark.createDataFrame([(batch_id, earlier)], "batch bigint, previous bigint")
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{root}/last")


def start_refresh(
    spark: SparkSession,
    folder: str,
    root: str,
    build: Builder,
    snapshots_per_batch: int = 1,
    interval: str | None = None,
) -> StreamingQuery:
    """Start the refresh stream over the snapshots published in a folder.

    Without ``interval`` the stream takes what is there and ends.
    """
    markers = (
        spark.readStream.schema(MARKER_SCHEMA)
        .option("maxFilesPerTrigger", snapshots_per_batch)
        .parquet(f"{folder}/markers")
    )
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        markers.writeStream.foreachBatch(lambda df, n: refresh_batch(df, n, root, build))
        .option("checkpointLocation", f"{root}/_stream")
        .trigger(**trigger)
        .start()
    )
