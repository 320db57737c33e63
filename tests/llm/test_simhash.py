import random

import numpy as np
import xxhash
from cases import SF, TEXTS, awkward, documents, lower

from assaylens.llm import components, simhash
from assaylens.llm.queries import QUERIES


def plain_fingerprint(text, size=3):
    ws = lower(text).encode().split()
    grams = [b" ".join(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))] if ws else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    fps = np.array(fps, dtype=np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            return label
        label = new


def test_query_against_brute_force(spark):
    docs = sorted(documents(spark))
    label = plain_components([plain_fingerprint(t) for _, t in docs])
    got = {r.doc_id: r for r in QUERIES["op10_simhash"](spark, SF).collect()}
    for (i, t), k in zip(docs, label, strict=True):
        assert got[i].fingerprint == f"{plain_fingerprint(t):016x}"
        assert got[i].component_id == docs[k][0]


def numbers(fps):
    return [int(np.uint64(f).astype(np.int64)) for f in fps]


def linked(spark, fps, crowd):
    values = numbers(fps)
    df = spark.createDataFrame([(v,) for v in values], "fp bigint")
    edges = [(r.a, r.b) for r in simhash.links(df, crowd).collect()]
    parent = {v: v for v in values}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        assert bin((a ^ b) & (2**64 - 1)).count("1") <= 2
        parent[root(a)] = root(b)
    return [root(v) for v in values]


def test_links_of_small_and_large_groups(spark):
    rng = random.Random(5)
    fps = {0, 2**64 - 1}
    for _ in range(6):
        seed = rng.getrandbits(64)
        fps.add(seed)
        for _ in range(60):
            f = rng.choice(sorted(fps)) if rng.random() < 0.3 else seed
            for _ in range(rng.randint(1, 4)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    expected = plain_components(fps)
    for crowd in (1, 8, 1000):
        got = linked(spark, fps, crowd)
        assert len({*zip(got, expected, strict=True)}) == len(set(got)) == len(set(expected))


def test_pivot_distances_differ_by_no_more_than_the_bits(spark):
    rng = random.Random(1)
    a = [rng.getrandbits(64) for _ in range(50)]
    b = [x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in a]
    df = spark.createDataFrame([(v,) for v in numbers(a + b)], "fp bigint")
    table = {(r.fp, r.t): r for r in simhash.pivot_table(df).collect()}
    for x, y in zip(numbers(a), numbers(b), strict=True):
        rows = [(table[x, t], table[y, t]) for t in range(6)]
        assert any(p.key == q.key for p, q in rows)
        assert all(abs(rows[0][0][f"p{k}"] - rows[0][1][f"p{k}"]) <= 2 for k in range(16))


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    df = spark.createDataFrame(path + star + [(7, 7)], "a bigint, b bigint")
    roots = {}
    for r in components.connected(df).collect():
        roots.setdefault(r.root, set()).add(r.node)
    assert sorted(map(len, roots.values())) == [50, 101]
    assert components.connected(df.limit(0)).count() == 0


def test_awkward_documents(spark):
    rows = simhash.classes(awkward(spark)).collect()
    assert len(rows) == len(TEXTS)
    empty = [r for r in rows if r.fp == 0]
    assert {r.id for r in empty} == {2, 3, 6, 9} and {r.component_id for r in empty} == {2}
    assert {r.component_id for r in rows if r.id in (4, 5)} == {4}
    df = awkward(spark)
    out = simhash.deduplicate(df)
    assert out.dtypes == df.dtypes and out.count() == 6
    assert simhash.deduplicate(df.limit(0)).count() == 0
