"""Which datasets changed, and replacing what they had.

``cached`` and ``live`` are manifests (accession, fingerprint). Comparisons are one
aggregation over the union of both sides rather than a join, so repeated or very
frequent accessions combine before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylens.functions.digest import set_fingerprint

CLASSES = ("fresh", "updated", "new", "dropped", "stale", "failed")
CLEARING = ("dropped", "failed")


def manifest(listing: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(accession, fingerprint) of a file listing."""
    named = columns or [c for c in listing.columns if c != "accession"]
    return listing.groupBy("accession").agg(
        set_fingerprint(*[F.col(c) for c in sorted(named)]).alias("fingerprint")
    )


def _sides(cached: DataFrame, live: DataFrame, *columns: str) -> DataFrame:
    mark = lambda df, is_live: df.select("accession", *columns, F.lit(is_live).alias("_live"))
    return mark(cached, False).unionByName(mark(live, True))


def membership(cached: DataFrame, live: DataFrame) -> DataFrame:
    """(accession, membership): dropped, new, or common to both sides."""
    flags = (
        _sides(cached, live)
        .groupBy("accession")
        .agg(F.bool_or("_live").alias("in_live"), F.bool_or(~F.col("_live")).alias("in_cached"))
    )
    return flags.select(
        "accession",
        F.when(~F.col("in_live"), "dropped")
        .when(~F.col("in_cached"), "new")
        .otherwise("common")
        .alias("membership"),
    )


def classify(
    cached: DataFrame, live: DataFrame, unreachable: DataFrame | None = None
) -> DataFrame:
    """(accession, class, fingerprint): what a refresh has to do with each dataset.

    fresh: unchanged; updated: changed; new: not cached yet; dropped: not live any
    more. Datasets in ``unreachable`` (accession) are live but could not be read:
    stale when cached, failed otherwise.
    """
    sides = _sides(cached, live, "fingerprint")
    if unreachable is not None:
        lost = unreachable.select("accession", F.lit(None).cast("string").alias("fingerprint"))
        sides = sides.unionByName(lost.withColumn("_live", F.lit(None).cast("boolean")))
    both = sides.groupBy("accession").agg(
        F.max(F.when(F.col("_live"), F.col("fingerprint"))).alias("_new"),
        F.max(F.when(~F.col("_live"), F.col("fingerprint"))).alias("_old"),
        F.coalesce(F.bool_or(F.col("_live").isNull()), F.lit(False)).alias("_lost"),
    )
    label = (
        F.when(F.col("_lost") & F.col("_old").isNotNull(), "stale")
        .when(F.col("_lost"), "failed")
        .when(F.col("_new").isNull(), "dropped")
        .when(F.col("_old").isNull(), "new")
        .when(F.col("_old") == F.col("_new"), "fresh")
        .otherwise("updated")
    )
    kept = F.when(F.col("class") == "stale", F.col("_old")).otherwise(F.col("_new"))
    return both.withColumn("class", label).select(
        "accession", "class", kept.alias("fingerprint")
    )


def class_counts(classes: DataFrame) -> DataFrame:
    """Number of datasets per class."""
    return classes.groupBy("class").agg(F.count(F.lit(1)).alias("n_datasets"))


def replace_datasets(
    stored: DataFrame, fresh_rows: DataFrame, classes: DataFrame, failed: DataFrame | None = None
) -> DataFrame:
    """Stored rows after a refresh.

    Rows of dropped datasets go; rows of updated and new ones give way to the fresh
    rows, so that doing it again changes nothing. Datasets in ``failed`` (accession) could not be parsed:
    nothing of them is kept. Fresh and stale datasets keep what they had.
    """
    gone = classes.filter(~F.col("class").isin("fresh", "stale")).select("accession")
    wanted = classes.filter(F.col("class").isin("updated", "new")).select("accession")
    if failed is not None:
        wanted = wanted.join(failed.select("accession"), "accession", "left_anti")
    kept = stored.join(gone, "accession", "left_anti")
    added = fresh_rows.join(wanted, "accession", "left_semi")
    return kept.unionByName(added)


def upsert(stored: DataFrame, updates: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Replace by key: the row of the greatest ``order`` per key, updates before stored."""
    rest = [c for c in stored.columns if c not in (*keys, order)]
    both = stored.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    newest = F.max(F.struct("_new", order, *rest)).alias("_row")
    return both.groupBy(*keys).agg(newest).select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}") for c in stored.columns]
    )


def current_status(
    log: DataFrame,
    keys: Sequence[str],
    time: Sequence[str] = ("report_ts",),
    accession: str = "accession",
) -> DataFrame:
    """The status log as it stands: (keys..., time...) of the latest report per key.

    A dropped or failed dataset first loses all its earlier entries. ``time`` orders
    the reports; further columns in it break ties.
    """
    when = F.struct(*time)
    cleared = (
        log.filter(F.col("status").isin(*CLEARING))
        .groupBy(accession)
        .agg(F.max(when).alias("_cleared"))
    )
    valid = log.join(cleared, accession, "left").filter(
        F.col("_cleared").isNull() | (when >= F.col("_cleared"))
    )
    return valid.groupBy(*keys).agg(F.max(when).alias("_t")).select(*keys, "_t.*")


# The column groups of the status view.
STATUS_VIEW = {
    "id": ("accession", "assay_name", "sample_name"),
    "information": ("report_ts", "report_type", "status"),
    "messages": ("error", "warning"),
    "report attributes": ("args", "kwargs"),
}


def status_view(log: DataFrame) -> DataFrame:
    """Distinct log entries in the columns of the status view; absent ones are NULL."""
    columns = [
        F.col(c) if c in log.columns else F.lit(None).cast("string").alias(c)
        for group in STATUS_VIEW.values()
        for c in group
    ]
    return log.select(*columns).distinct()
