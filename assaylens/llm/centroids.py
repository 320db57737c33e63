"""Centroid clustering with a Walsh-Hadamard progressive search; exact integers throughout.

Components become integers, and vectors and centroids are transformed by the Walsh-Hadamard
matrix, which multiplies all squared distances by the number of components. Its first
coefficients are sums over many components, so they tell most of a distance. For each
vector the squared differences of coefficients are summed coarse to fine, in steps of
growing length. After the first step the centroid in front is finished, which gives a
distance that is reached; after each further step the centroids whose sum is already
larger are out, for sums only grow. What is left has all coefficients and is exact, so the
smallest number among the nearest is the answer.

Spark keeps the transformed vectors once. A round is one pass over them: a task assigns
its vectors and returns for each centroid a count and the sums of its coefficients, which
are added up by Spark. The transform is linear, so those sums give the sums of components.
The centroids, at most ``K`` vectors, are all that the driver and the tasks exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.llm.tables import release, stored

SIZE = 64  # components
SCALE = 256
K = 40
ROUNDS = 5
STEPS = (4, 8, 16, 32, 64)  # coefficients that are summed after each step
SAFE = 1 << 24  # integers up to here stay exact in 64 bits; larger ones take Python's
ROWS = 4096  # vectors that a task assigns at a time


def transform(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, the rows of the matrix by their sign changes.

    The length must be a power of two. In its natural order the matrix times itself is the
    length on the diagonal, which ``invert`` uses.
    """
    out = rows.copy()
    n = out.shape[1]
    half = 1
    while half < n:
        pairs = out.reshape(len(out), n // (2 * half), 2, half)
        a, b = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        pairs[:, :, 0], pairs[:, :, 1] = a + b, a - b
        half *= 2
    return out[:, coarse_to_fine(n)]


def coarse_to_fine(n: int) -> list[int]:
    """Numbers of the rows of the natural matrix in the order of their sign changes."""
    bits = n.bit_length() - 1
    order = []
    for changes in range(n):
        gray = changes ^ (changes >> 1)
        order.append(int(f"{gray:0{bits}b}"[::-1], 2) if bits else 0)
    return order


def invert(rows: np.ndarray) -> np.ndarray:
    """The vectors of transformed rows, as exact integers."""
    n = rows.shape[1]
    natural = np.empty_like(rows)
    natural[:, coarse_to_fine(n)] = rows
    back = transform(natural)
    out = np.empty_like(back)
    out[:, coarse_to_fine(n)] = back
    return out // n


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each transformed row the nearest transformed centroid and the squared distance.

    The distance is that of the transformed ones: as often that of the vectors as they
    have components. Of equally near centroids the one with the smallest number counts.
    """
    steps = [s for s in STEPS if s < rows.shape[1]] + [rows.shape[1]]
    n = len(rows)
    difference = rows[:, None, : steps[0]] - centroids[None, :, : steps[0]]
    sums = np.einsum("nkc,nkc->nk", difference, difference)
    front = sums.argmin(axis=1)
    rest = rows[:, steps[0] :] - centroids[front, steps[0] :]
    reached = sums[np.arange(n), front] + np.einsum("nc,nc->n", rest, rest)
    # pairs of a row and a centroid, by row and then by number, as they stay
    at, number = np.nonzero(sums <= reached[:, None])
    left = sums[at, number]
    for begin, end in zip(steps, steps[1:]):
        difference = rows[at, begin:end] - centroids[number, begin:end]
        left = left + np.einsum("pc,pc->p", difference, difference)
        # out is what is strictly worse than a distance that is reached
        alive = left <= reached[at]
        at, number, left = at[alive], number[alive], left[alive]
    least = np.minimum.reduceat(left, np.searchsorted(at, np.arange(n))) if n else left
    winners = np.flatnonzero(left == least[at])
    first = winners[np.unique(at[winners], return_index=True)[1]]
    return number[first], left[first]


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches that are small enough to compare with all centroids."""
    for batch in batches:
        for start in range(0, len(batch), ROWS):
            part = batch.slice(start, ROWS)
            yield part, _matrix(part.column(column))


def transformed(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, coefficients) of all vectors that count, stored."""
    source = vectors.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double")).alias("vector"),
    ).where(
        (F.size("vector") == SIZE)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _parts(batches, 1):
            scaled = np.floor(rows * SCALE)
            if (np.abs(scaled) > SAFE).any():
                raise ValueError(f"a component is beyond {SAFE // SCALE}: squared distances may not fit 64 bits")
            out = transform(scaled.astype(np.int64))
            offsets = pa.array(np.arange(len(out) + 1, dtype=np.int32) * SIZE)
            coefficients = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), coefficients], names=["id", "coefficients"])

    return stored(source.mapInArrow(run, "id bigint, coefficients array<bigint>"), "coefficients")


def seeds(table: DataFrame, k: int) -> np.ndarray:
    """The transformed vectors whose ids have the smallest hashes, in the order of the hashes.

    Rows with one id are ordered by their coefficients.
    """
    name = F.concat(F.lit("2:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    chosen = table.orderBy(F.sha2(name.cast("binary"), 256), "coefficients").limit(k)
    rows = [r.coefficients for r in chosen.select("coefficients").collect()]
    return np.array(rows, np.int64).reshape(len(rows), SIZE)


def moved(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The transformed centroids after one round: the floors of the means of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(centroids), np.int64)
        sums = np.zeros(centroids.shape, np.int64)
        for _, rows in _parts(batches, 0):
            number, _ = nearest(rows, centroids)
            counts += np.bincount(number, minlength=len(centroids))
            np.add.at(sums, number, rows)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used.astype(np.int32)),
                pa.array(counts[used]),
                pa.array(list(sums[used]), pa.list_(pa.int64())),
            ],
            names=["cluster", "n", "sums"],
        )

    found = table.select("coefficients").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    total = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(SIZE)]
    # a row for each centroid that has vectors
    rows = found.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect()
    out = centroids.copy()
    for row in rows:
        sums = np.array([[int(row[f"s{i}"]) for i in range(SIZE)]], dtype=object)
        mean = invert(sums) // int(row["n"])
        out[row["cluster"]] = transform(mean.astype(np.int64))[0]
    return out


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, rounds: int = ROUNDS
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid) for each vector that counts.

    Those are the vectors of exactly ``SIZE`` components, none NULL, NaN or infinite; a
    component x is taken as floor(256 * x). Rows that repeat count as often, a NULL id is
    an id like any other (its hash is that of no digits). With fewer than ``k`` vectors each
    is a centroid at first; with none there are no rows. Components beyond 65,536, whose
    squared distances may not fit 64 bits, are an error. Other columns are not looked at.
    ``centroid`` has the components of the last centroid of the cluster.
    """
    spark = vectors.sparkSession
    table = transformed(vectors, id_col, vector_col)
    centroids = seeds(table, k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(table, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in _parts(batches, 1):
            number, distance = nearest(rows, centroids)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number.astype(np.int32)), pa.array(distance // SIZE)],
                names=["id", "cluster", "distance"],
            )

    assigned = stored(table.mapInArrow(run, "id bigint, cluster int, distance bigint"), "assigned")
    release(table)
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r.cluster: int(r.inertia) for r in assigned.groupBy("cluster").agg(exact.alias("inertia")).collect()}
    components = invert(centroids).tolist()
    summary = spark.createDataFrame(
        [(n, inertia[n], sum(inertia.values()), components[n]) for n in sorted(inertia)],
        "number int, cluster_inertia bigint, inertia bigint, centroid array<bigint>",
    )
    # at most k rows
    return assigned.join(F.broadcast(summary), F.col("cluster") == F.col("number")).drop("number")


def centroid_digest(centroid: Column) -> Column:
    """SHA-256 of components as decimal integers joined by commas."""
    return F.sha2(F.array_join(centroid.cast("array<string>"), ",").cast("binary"), 256)
