import hashlib
import math
import random

import numpy as np
import pytest
from cases import SF
from compare import compare, connect

from assaylens.llm import centroids
from assaylens.llm.queries import QUERIES, SQL


def brute(rows, k=centroids.K, rounds=centroids.ROUNDS):
    """The clusters of (id, vector) rows in plain Python: row -> (cluster, distance), and the centroids."""
    kept = [
        (i, [math.floor(256 * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    middle = [v for _, v in sorted(kept, key=lambda row: name(row[0]))[:k]]

    def assign():
        square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
        return [min((square(v, c), n) for n, c in enumerate(middle)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for n in range(len(middle)):
            mine = [v for (_, v), (_, at) in zip(kept, found) if at == n]
            if mine:
                middle[n] = [sum(xs) // len(mine) for xs in zip(*mine)]
    return [(i, n, d) for (i, _), (d, n) in zip(kept, assign())], middle


def test_query_against_sql(spark):
    df = QUERIES["op13_centroids"](spark, SF)
    assert compare(df, connect(SF), SQL["op13_centroids"]) is None


def test_transform_is_that_of_sign_changes():
    basis = centroids.transform(np.eye(64, dtype=np.int64))
    assert [int((np.diff(column) != 0).sum()) for column in basis.T] == list(range(64))
    assert (basis.T @ basis == 64 * np.eye(64)).all()
    draw = np.random.default_rng(1)
    rows = draw.integers(-(2**24), 2**24, (50, 64))
    assert (centroids.invert(centroids.transform(rows)) == rows).all()
    huge = rows.astype(object) * 10**30
    assert (centroids.invert(centroids.transform(huge)) == huge).all()


@pytest.mark.parametrize("spread", [1, 3, 200, 2**24])
def test_search_is_exact_with_ties(spread):
    draw = np.random.default_rng(spread)
    rows = draw.integers(-spread, spread + 1, (300, 64))
    middle = draw.integers(-spread, spread + 1, (20, 64))
    middle[11] = middle[3]  # equally near everywhere
    rows[5] = middle[11]
    number, distance = centroids.nearest(centroids.transform(rows), centroids.transform(middle))
    exact = ((rows[:, None].astype(object) - middle[None].astype(object)) ** 2).sum(axis=2)
    assert [int(n) for n in number] == [min(range(20), key=lambda n: (row[n], n)) for row in exact]
    assert [int(d) // 64 for d in distance] == [min(row) for row in exact]
    assert all(int(d) % 64 == 0 for d in distance) and number[5] == 3


def vectors(spark, rows):
    return spark.createDataFrame(
        [(i, v, "c", 1) for i, v in rows], "vec_id bigint, embedding array<float>, cluster string, coefficients int"
    )


def test_against_brute_force(spark):
    draw = random.Random(1)
    made = [[np.float32(draw.gauss(c, 0.2)) for _ in range(64)] for c in range(3) for _ in range(40)]
    rows = [(i, list(map(float, v))) for i, v in enumerate(made)]
    rows += [(7, rows[7][1]), (200, rows[8][1]), (None, rows[9][1])]
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65), (304, [0.5] * 63 + [None])]
    rows += [(305, [0.5] * 63 + [float("nan")]), (306, [float("inf")] + [0.5] * 63)]
    for k in (centroids.K, 3, 500):
        want, middle = brute(rows, k)
        got = centroids.cluster(vectors(spark, rows), k=k).collect()
        key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
        assert sorted(((r.id, r.cluster, r.distance) for r in got), key=key) == sorted(want, key=key)
        for r in got:
            assert r.centroid == middle[r.cluster]
            assert r.cluster_inertia == sum(d for _, n, d in want if n == r.cluster)
            assert r.inertia == sum(d for _, _, d in want)


def test_small_and_empty_tables(spark):
    same = vectors(spark, [(i, [0.25] * 64) for i in range(50)])
    assert {(r.cluster, r.distance) for r in centroids.cluster(same).collect()} == {(0, 0)}
    assert centroids.cluster(same.limit(0)).collect() == []
    assert [(r.cluster, r.inertia) for r in centroids.cluster(same.limit(1)).collect()] == [(0, 0)]
    with pytest.raises(Exception, match="beyond"):
        centroids.cluster(vectors(spark, [(1, [1e30] * 64)]))
