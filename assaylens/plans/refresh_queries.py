"""Registered queries on refreshing datasets and on the status log."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylens.operators import refresh
from assaylens.plans import fixtures as fx
from assaylens.plans.ingest_queries import ingest_datasets
from assaylens.plans.registry import query
from assaylens.session import scratch_path
from assaylens.sources.tables import stale_tables
from assaylens.streaming import keyed
from assaylens.streaming.refresh import (
    publish_snapshot,
    read_manifest,
    read_status,
    read_store,
    start_refresh,
)


def _manifests(spark, sf_dir):
    return refresh.manifest(fx.cached_listing(spark, sf_dir)), refresh.manifest(
        fx.live_listing(spark, sf_dir)
    )


def _classes(spark, sf_dir):
    return refresh.classify(*_manifests(spark, sf_dir))


@query(
    "u1_membership",
    """SELECT CAST(accession AS VARCHAR) AS accession, CASE class WHEN 'dropped' THEN 'dropped'
              WHEN 'new' THEN 'new' ELSE 'common' END AS membership FROM fx_classes""",
)
def u1(spark, sf_dir):
    return refresh.membership(fx.cached_listing(spark, sf_dir), fx.live_listing(spark, sf_dir))


@query("u2_classes", "SELECT CAST(accession AS VARCHAR) AS accession, class FROM fx_classes")
def u2(spark, sf_dir):
    return _classes(spark, sf_dir).select("accession", "class")


def _rows(listing, source):
    return listing.select("accession", "filename", "ts", F.lit(source).alias("source"))


@query(
    "u3_replace_datasets",
    """SELECT CAST(o_custkey AS VARCHAR) AS accession, concat('file', o_orderkey) AS filename, 'old' AS source
       FROM orders JOIN fx_classes ON accession = o_custkey
       WHERE class = 'fresh' AND o_custkey % 5 <> 0
         AND (o_orderdate < TIMESTAMP '2000-01-01 00:00:00' OR o_custkey % 7 = 0)
       UNION ALL
       SELECT CAST(o_custkey AS VARCHAR), concat('file', o_orderkey), 'new'
       FROM orders JOIN fx_classes ON accession = o_custkey
       WHERE class IN ('new', 'updated') AND (o_custkey % 7 <> 0 OR o_custkey % 5 = 0) AND o_custkey % 11 <> 0""",
)
def u3(spark, sf_dir):
    """Every eleventh dataset cannot be parsed: its rows go and none come."""
    cached, live = fx.cached_listing(spark, sf_dir), fx.live_listing(spark, sf_dir)
    classes = _classes(spark, sf_dir)
    failed = classes.filter(F.col("accession").cast("bigint") % 11 == 0).select("accession")
    stored = refresh.replace_datasets(_rows(cached, "old"), _rows(live, "new"), classes, failed)
    return stored.select("accession", "filename", "source")


@query(
    "u4_upsert",
    """SELECT coalesce(l.accession, c.accession) AS accession, coalesce(l.n_files, c.n_files) AS n_files,
              CAST(epoch(coalesce(l.ts, c.ts)) AS BIGINT) AS ts
       FROM fx_cached c FULL JOIN fx_live l ON c.accession = l.accession""",
)
def u4(spark, sf_dir):
    def records(listing):
        counts = listing.groupBy(F.col("accession").cast("bigint").alias("accession"))
        return counts.agg(F.count(F.lit(1)).alias("n_files"), F.max("ts").alias("ts"))

    stored = records(fx.cached_listing(spark, sf_dir))
    return refresh.upsert(stored, records(fx.live_listing(spark, sf_dir)), ["accession"], "ts")


@query(
    "u5_stale_tables",
    """SELECT l.filename AS identifier, l.ts,
              CASE WHEN c.filename IS NULL THEN 'missing' WHEN c.n > 1 THEN 'conflicting'
                   WHEN c.ts < l.ts THEN 'outdated' END AS reason
       FROM fx_latest l LEFT JOIN (
           SELECT filename, max(ts) AS ts, count(*) AS n FROM (
               SELECT filename, ts - 10 * (version % 2) AS ts FROM fx_latest WHERE filename NOT LIKE 'GLDS-1%'
               UNION ALL SELECT filename, ts FROM fx_latest WHERE filename LIKE 'GLDS-2%')
           GROUP BY 1) c ON l.filename = c.filename
       WHERE c.filename IS NULL OR c.n > 1 OR c.ts < l.ts""",
)
def u5(spark, sf_dir):
    source = fx.latest(spark, sf_dir).select(F.col("filename").alias("identifier"), "version", "ts")
    name = F.col("identifier")
    once = source.filter(~name.startswith("GLDS-1")).select(
        "identifier", (F.col("ts") - 10 * (F.col("version") % 2)).alias("ts")
    )
    twice = source.filter(name.startswith("GLDS-2")).select("identifier", "ts")
    return stale_tables(source.drop("version"), once.unionByName(twice))


@query(
    "u7_current_status",
    """SELECT accession, status, max(report_ts) AS report_ts FROM (
           SELECT s.*, max(CASE WHEN status IN ('dropped', 'failed') THEN k END) OVER (PARTITION BY accession) AS cut
           FROM (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY report_ts, event_id) AS k
                 FROM fx_status) s)
       WHERE cut IS NULL OR k >= cut GROUP BY 1, 2""",
)
def u7(spark, sf_dir):
    log = fx.status_log(spark, sf_dir)
    return refresh.current_status(log, ["accession", "status"], ["report_ts", "event_id"]).drop("event_id")


@query(
    "u8_status_view",
    """SELECT DISTINCT accession, CAST(NULL AS VARCHAR) AS assay_name, CAST(NULL AS VARCHAR) AS sample_name,
              report_ts, 'dataset status' AS report_type, status, CAST(NULL AS VARCHAR) AS error,
              CAST(NULL AS VARCHAR) AS warning, CAST(NULL AS VARCHAR) AS args, CAST(NULL AS VARCHAR) AS kwargs
       FROM fx_status""",
)
def u8(spark, sf_dir):
    log = fx.status_log(spark, sf_dir).withColumn("report_type", F.lit("dataset status"))
    return refresh.status_view(log)


@query("a12_distinct_status", "SELECT DISTINCT accession, status FROM fx_status")
def a12(spark, sf_dir):
    return refresh.status_view(fx.status_log(spark, sf_dir)).select("accession", "status").distinct()


@query(
    "u10_class_counts",
    "SELECT class, CAST(count(*) AS BIGINT) AS n_datasets FROM fx_classes GROUP BY 1",
)
def u10(spark, sf_dir):
    return refresh.class_counts(_classes(spark, sf_dir))


_REFRESHED = """SELECT CAST(o_custkey AS VARCHAR) AS accession, concat('file', o_orderkey) AS filename,
       CAST(CASE class WHEN 'fresh' THEN 0 ELSE 1 END AS BIGINT) AS data_batch
FROM orders JOIN fx_classes ON accession = o_custkey
WHERE class <> 'dropped' AND (o_custkey % 7 <> 0 OR o_custkey % 5 = 0)"""


@query("u9_continuous_refresh", _REFRESHED)
def u9(spark, sf_dir):
    """Two snapshots through the stream; rows of unchanged datasets stay where they were."""
    folder, root = scratch_path(spark, "snapshots"), scratch_path(spark, "store")
    publish_snapshot(fx.cached_listing(spark, sf_dir), folder, 0)
    publish_snapshot(fx.live_listing(spark, sf_dir), folder, 1)
    stream = start_refresh(spark, folder, root, build=lambda rows: rows)
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()
    placed = read_manifest(spark, root).select("accession", "data_batch")
    return read_store(spark, root).join(placed, "accession").select("accession", "filename", "data_batch")


_DATASETS = """d AS (SELECT s_suppkey AS k, s_suppkey % 6 IN (0, 4, 5) AS sound,
    s_suppkey % 4 <> 0 AND s_suppkey % 6 IN (0, 4, 5) AS cached FROM supplier)"""


def _polls(spark, sf_dir):
    """What two polls found: the listing of each, and what the second could not reach."""
    key = F.col("s_suppkey").cast("bigint")
    listing = fx.table(spark, sf_dir, "supplier").select(
        fx.numbered("GLDS-", key).alias("accession"), F.lit("x.zip").alias("filename"), key.alias("key")
    )
    first = listing.filter("key % 4 <> 0").withColumn("ts", F.lit(0))
    later = listing.filter("key % 9 <> 0").withColumn("ts", F.when(F.col("key") % 5 == 0, 1).otherwise(0))
    return first, later, listing.filter("key % 7 = 0")


def _build_samples(rows):
    samples, failures = ingest_datasets(rows.select("accession", "key"))
    return samples.select("accession", "assay_name", "sample_name", "study_name"), failures


def _refreshed(spark, sf_dir):
    """Datasets read from archives over two snapshots: some broken, some lost, some dropped."""
    first, later, lost = _polls(spark, sf_dir)
    folder, root = scratch_path(spark, "snapshots"), scratch_path(spark, "store")
    publish_snapshot(first, folder, 0)
    publish_snapshot(later, folder, 1, lost)
    stream = start_refresh(spark, folder, root, _build_samples)
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()
    return root


_REFRESHED_SAMPLES = f"""WITH {_DATASETS}
SELECT concat('GLDS-', CAST(k AS VARCHAR)) AS accession, concat('s', CAST(k AS VARCHAR)) AS sample_name,
       CAST(CASE WHEN k % 7 = 0 OR (cached AND k % 5 <> 0) THEN 0 ELSE 1 END AS BIGINT) AS data_batch
FROM d WHERE (k % 7 = 0 AND cached) OR (k % 7 <> 0 AND k % 9 <> 0 AND sound)"""


@query("u9_refresh_with_failures", _REFRESHED_SAMPLES)
def u9_failures(spark, sf_dir):
    root = _refreshed(spark, sf_dir)
    placed = read_manifest(spark, root).select("accession", "data_batch")
    return read_store(spark, root).join(placed, "accession").select("accession", "sample_name", "data_batch")


def _keyed(spark, folder, build):
    """The stream over what has been announced so far; the folder of its store."""
    root = f"{folder}/store"
    stream = keyed.start(spark, folder, root, build)
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()
    return root


@query("u9_keyed_refresh", _REFRESHED)
def u9_keyed(spark, sf_dir):
    """Two polls through keyed state; only datasets that changed are events."""
    folder = scratch_path(spark, "polls")
    for number, listed in enumerate((fx.cached_listing(spark, sf_dir), fx.live_listing(spark, sf_dir))):
        keyed.announce(listed, folder, number)
        root = _keyed(spark, folder, lambda rows: rows)
    placed = keyed.read_current(spark, root).select("accession", F.col("snapshot").alias("data_batch"))
    return keyed.read_store(spark, root).join(placed, "accession").select("accession", "filename", "data_batch")


@query("u9_keyed_failures", _REFRESHED_SAMPLES)
def u9_keyed_failures(spark, sf_dir):
    """Broken, lost and dropped datasets through keyed state."""
    first, later, lost = _polls(spark, sf_dir)
    folder = scratch_path(spark, "polls")
    for number, (listed, unreachable) in enumerate(((first, None), (later, lost))):
        keyed.announce(listed, folder, number, unreachable)
        root = _keyed(spark, folder, _build_samples)
    placed = keyed.read_current(spark, root).select("accession", F.col("snapshot").alias("data_batch"))
    return keyed.read_store(spark, root).join(placed, "accession").select("accession", "sample_name", "data_batch")


@query(
    "u7_status_of_refresh",
    f"""WITH {_DATASETS},
        log AS (
            SELECT k, CASE WHEN sound THEN 'new' ELSE 'failed' END AS status, 0 AS ts FROM d WHERE k % 4 <> 0
            UNION ALL
            SELECT k, CASE WHEN k % 7 = 0 THEN CASE WHEN cached THEN 'stale' ELSE 'failed' END
                           WHEN k % 9 = 0 THEN 'dropped'
                           WHEN cached THEN CASE WHEN k % 5 = 0 THEN 'updated' ELSE 'fresh' END
                           WHEN sound THEN 'new' ELSE 'failed' END, 1
            FROM d WHERE k % 7 = 0 OR k % 9 <> 0 OR cached),
        cut AS (SELECT k, max(ts) AS ts FROM log WHERE status IN ('dropped', 'failed') GROUP BY k)
        SELECT concat('GLDS-', CAST(l.k AS VARCHAR)) AS accession, status, CAST(max(l.ts) AS BIGINT) AS report_ts
        FROM log l LEFT JOIN cut ON l.k = cut.k WHERE cut.ts IS NULL OR l.ts >= cut.ts GROUP BY 1, 2""",
)
def u7_refresh(spark, sf_dir):
    return refresh.current_status(read_status(spark, _refreshed(spark, sf_dir)), ["accession", "status"])
