"""Near-duplicates by SimHash, found through pivot distance tables.

Fingerprints of 64 bits are linked if at most two bits differ. For every distinct
fingerprint the Hamming distances to fixed reference fingerprints (pivots) are computed
once. The pivots are the rows of a 16 x 16 Hadamard matrix, laid over each of the four
16-bit blocks and, repeated four times, over the whole fingerprint.

* Distances to the pivots of a block differ nowhere if and only if the block is the same.
  Two fingerprints within two bits agree on at least two of the four blocks, so they share
  the distance vector of at least one of the six pairs of blocks: the candidates.
* By the triangle inequality the distances of two linked fingerprints to any pivot differ
  by at most two. Candidates whose largest coordinate difference is greater are discarded.
* The survivors are verified bit by bit.

A group of more than ``CROWD`` fingerprints with one distance vector is not paired up.
Its members are linked through what lies between them instead: two fingerprints differ
in at most two bits exactly if some fingerprint is within one bit of both, so each member
is listed under itself and its 64 neighbours, and those listed under the same one are
linked. That takes 65 rows per member, whatever the size of the group, and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylens.llm.components import connected
from assaylens.llm.tables import fresh, stored

CROWD = 64
BLOCKS, WIDTH = 4, 16
LINKED = 2


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), dtype=np.int16)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return h


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of all shingles of the words of a text, repeats included."""
    # bytes.lower() touches A-Z only, bytes.split() parts at \x20 and \x09-\x0D only
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(size, len(parts))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(parts) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in spans), dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes, as a signed number; zero for no hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def fingerprints(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    row_col: str | None = None,
) -> DataFrame:
    """(id, row, fp) of every document, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), size)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps, pa.int64())], names=["id", "row", "fp"]
            )

    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    source = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), row.alias("row"), F.col(f"`{text_col}`").alias("text")
    )
    return stored(source.mapInArrow(run, "id bigint, row bigint, fp bigint"), "fingerprints")


PAIRS = tuple(combinations(range(BLOCKS), 2))
PIVOTS = [f"p{k}" for k in range(WIDTH)]


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pivots = _hadamard(WIDTH)
    for batch in batches:
        fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
        bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        signs = 1 - 2 * bits.reshape(-1, BLOCKS, WIDTH).astype(np.int16)
        # distance to a pivot: half of the width less the agreement
        table = ((WIDTH - signs @ pivots.T) // 2).astype(np.int8)
        keys = []
        for a, b in PAIRS:
            vectors = np.ascontiguousarray(table[:, (a, b), :].reshape(-1, 2 * WIDTH))
            keys.append(pa.array([v.tobytes() for v in vectors], pa.binary()))
        whole = table.sum(axis=1, dtype=np.int8)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *keys, *[pa.array(whole[:, k], pa.int8()) for k in range(WIDTH)]],
            names=["fp", *[f"k{t}" for t in range(len(PAIRS))], *PIVOTS],
        )


def pivot_table(distinct: DataFrame) -> DataFrame:
    """A row for each fingerprint and pair of blocks: t, the vector's key, fp, p0 to p15."""
    schema = ", ".join(
        ["fp bigint", *[f"k{t} binary" for t in range(len(PAIRS))], *[f"{p} tinyint" for p in PIVOTS]]
    )
    table = distinct.select("fp").mapInArrow(_distances, schema)
    # a vector of 32 small numbers is as good as its hash: unequal vectors that meet are told apart below
    keys = F.array(*[F.xxhash64(F.lit(t), F.col(f"k{t}")) for t in range(len(PAIRS))])
    return table.select("fp", *PIVOTS, F.posexplode(keys).alias("t", "key"))


def links(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) that connect all fingerprints within two bits of each other.

    Pairs of small groups are links themselves. In a large group a fingerprint is linked
    to the smallest one listed with it, which connects the same ones.
    """
    table = stored(pivot_table(distinct), "pivots")
    groups = table.groupBy("t", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    groups = stored(groups, "groups")
    met = table.join(groups, ["t", "key"])
    small = met.where(F.col("members") <= crowd)
    a, b = small.alias("a"), small.alias("b")
    near = F.col("a.fp") < F.col("b.fp")
    for p in PIVOTS:
        near &= F.abs(F.col(f"a.{p}") - F.col(f"b.{p}")) <= LINKED
    near &= F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= LINKED
    same = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key"))
    paired = a.join(b, same & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))

    crowded = met.where(F.col("members") > crowd).select("fp").distinct()
    flips = F.concat(
        F.array(F.col("fp")),
        F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i))),
    )
    listed = stored(crowded.select("fp", F.explode(flips).alias("between")), "between")
    firsts = listed.groupBy("between").agg(F.min("fp").alias("a"), F.max("fp").alias("z"))
    firsts = stored(firsts.where("a <> z").select("between", "a"), "firsts")
    bridged = listed.join(firsts, "between").where("a <> fp").select("a", F.col("fp").alias("b"))
    return paired.union(bridged)


def classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 3,
    row_col: str | None = None,
) -> DataFrame:
    """For each document: id, row, fp, component_id and first_row.

    component_id is the smallest id that links lead to, first_row tells the row that has
    it (of rows repeating the id the first). NULL and empty texts have the fingerprint
    zero and link like any other; a text of fewer words than a shingle is one shingle. A
    NULL id is passed over unless the component has no other. No rows give no rows; other
    columns are not looked at.
    """
    rows = fingerprints(docs, id_col, text_col, size, row_col)
    # NULL ids last
    first = F.min(F.struct(F.col("id").isNull().alias("no"), F.col("id").alias("id"), F.col("row").alias("row")))
    distinct = stored(rows.groupBy("fp").agg(first.alias("first")), "distinct")
    roots = connected(links(distinct))
    members = stored(
        distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
            "fp", "first", F.coalesce("root", "fp").alias("root")
        ),
        "members",
    )
    best = stored(members.groupBy("root").agg(F.min("first").alias("best")), "best")
    labels = stored(members.join(best, "root").select(F.col("fp").alias("label_fp"), "best"), "labels")
    return rows.join(labels, F.col("fp") == F.col("label_fp")).select(
        "id", "row", "fp", F.col("best.id").alias("component_id"), F.col("best.row").alias("first_row")
    )


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3
) -> DataFrame:
    """One document of each component, the one with the smallest id, with its columns."""
    row = fresh(docs, "_row")
    tagged = stored(docs.withColumn(row, F.monotonically_increasing_id()), "tagged")
    found = classes(tagged, id_col, text_col, size, row)
    dropped = stored(
        found.where(F.col("row") != F.col("first_row")).select(F.col("row").alias(row)), "dropped"
    )
    return tagged.join(dropped, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
