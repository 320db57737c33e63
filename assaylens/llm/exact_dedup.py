"""Exact duplicates by a tree merge of sorted digest runs.

Every task turns its documents into a run of digests. In each round the runs whose
numbers agree but for the lowest digit (to the base ``FAN_IN``) meet: their entries
are shuffled together, sorted by digest and merged, so that one entry is left for each
digest of the merged run, with the identifier that stays and the number of rows. A
digest that a third of all rows have is one entry per run from the first round on, so
no task ever gets its rows. After the last round each digest has a single entry.

Entries merge only if SHA-256, the length and a second hash of the text all agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylens.llm.tables import fresh, stored

FAN_IN = 32
KEY = ("sha", "n_bytes", "check")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sha, length, check = [], [], []
        for text in batch.column(1):
            # bytes.lower() touches A-Z only
            data = (text.as_py() or "").encode("utf-8", "surrogatepass").lower()
            sha.append(hashlib.sha256(data).digest())
            length.append(len(data))
            check.append(xxhash.xxh64_intdigest(data) - 2**63)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array(sha, pa.binary()),
                pa.array(length, pa.int64()),
                pa.array(check, pa.int64()),
            ],
            names=["id", "row", *KEY],
        )


def digest_rows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None
) -> DataFrame:
    """(id, row, sha, n_bytes, check, run) of every document, stored; NULL text is empty."""
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    source = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        row.alias("row"),
    )
    rows = source.mapInArrow(
        _digests, "id bigint, row bigint, sha binary, n_bytes bigint, check bigint"
    )
    return stored(rows.withColumn("run", F.spark_partition_id()), "digests")


def merge_runs(rows: DataFrame, keep: str = "smallest", fan_in: int = FAN_IN) -> DataFrame:
    """One entry per digest: its key, the row that stays as ``best`` (id, row) and ``n``."""
    choose = F.min if keep == "smallest" else F.max
    runs = rows.agg(F.max("run")).head()[0]
    entries = rows.select(*KEY, "run", F.struct("id", "row").alias("best"), F.lit(1).cast("bigint").alias("n"))
    last = 1 if runs is None else int(runs) + 1
    while last > 1:
        # a run is sorted by digest; runs that meet are merged into the next, longer run
        entries = (
            entries.withColumn("run", F.floor(F.col("run") / F.lit(fan_in)).cast("int"))
            .groupBy("run", *KEY)
            .agg(choose("best").alias("best"), F.sum("n").alias("n"))
        )
        last = -(-last // fan_in)
    return entries.groupBy(*KEY).agg(choose("best").alias("best"), F.sum("n").alias("n"))


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    row_col: str | None = None,
) -> DataFrame:
    """For each document: id, row, keep_id, group_size, kept and text_sha256.

    NULL text counts as empty, an empty text is a text like any other. Texts are equal
    if they agree after lower-casing A-Z. Exactly one row of each class is kept: the one
    with the smallest (or largest) id, of rows repeating that id the first (last) read;
    a NULL id counts as smaller than all others. No rows give no rows. Other columns are
    not looked at. ``row_col`` names a column that tells rows apart, if there is one.
    """
    rows = digest_rows(docs, id_col, text_col, row_col)
    # only digests of several rows need looking up; stored, so that the join below has two
    # plain exchanges and a hot digest can be split
    repeated = stored(merge_runs(rows, keep).where("n > 1"), "repeated")
    found = repeated.select(*[F.col(k).alias(f"r_{k}") for k in KEY], "best", "n")
    same = [F.col(k) == F.col(f"r_{k}") for k in KEY]
    joined = rows.join(found, same, "left")
    alone = F.col("n").isNull()
    return joined.select(
        "id",
        "row",
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        (alone | (F.col("row") == F.col("best.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest"
) -> DataFrame:
    """The documents that stay, with their columns; ``classes`` says which those are."""
    row = fresh(docs, "_row")
    tagged = stored(docs.withColumn(row, F.monotonically_increasing_id()), "tagged")
    decided = classes(tagged, id_col, text_col, keep, row)
    dropped = stored(decided.where(~F.col("kept")).select(F.col("row").alias(row)), "dropped")
    return tagged.join(dropped, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
