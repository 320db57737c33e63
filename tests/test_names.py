import random

import pytest
from pyspark.errors import PySparkException

from assaylens.operators import names

BY = ["accession"]


def frames(spark, ours, theirs):
    return (
        spark.createDataFrame([("D", n) for n in ours], "accession string, name string"),
        spark.createDataFrame([("D", n) for n in theirs], "accession string, candidate string"),
    )


def brute_force(name, candidates):
    dots = lambda s: s.replace("_", ".").replace("-", ".")
    tests = (
        lambda c: c == name,
        lambda c: dots(c) == dots(name),
        lambda c: dots(c).startswith(dots(name)) or dots(name).startswith(dots(c)),
    )
    for tier, test in enumerate(tests, 1):
        found = sorted(c for c in candidates if test(c))
        if found:
            return tier, found
    return None, []


def test_tiers_match_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("ab._-1") for _ in range(rng.randrange(1, 6)))
    ours, theirs = sorted({word() for _ in range(80)}), sorted({word() for _ in range(60)})
    expected = {n: brute_force(n, theirs) for n in ours}
    a, b = frames(spark, ours, theirs)
    pairs = {}
    for row in names.all_matches(a, b, BY).collect():
        pairs.setdefault(row["name"], (row["tier"], []))[1].append(row["candidate"])
    assert {n: (t, sorted(c)) for n, (t, c) in pairs.items()} == {n: e for n, e in expected.items() if e[1]}
    for row in names.best_match(a, b, BY).collect():
        tier, found = expected[row["name"]]
        assert (row["tier"], row["n_matches"]) == (tier, len(found))
        assert row["candidate"] == (found[0] if len(found) == 1 else None)


def test_a_better_tier_hides_a_worse_one(spark):
    a, b = frames(spark, ["s.1"], ["s.1", "s_1", "s-1-rep"])
    assert [(r["tier"], r["candidate"]) for r in names.all_matches(a, b, BY).collect()] == [(1, "s.1")]
    a, b = frames(spark, ["s.1"], ["s_1", "s-1-rep"])
    assert [(r["tier"], r["candidate"]) for r in names.best_match(a, b, BY).collect()] == [(2, "s_1")]


def test_names_match_inside_their_dataset_only(spark):
    a = spark.createDataFrame([("D-1", "x"), ("D-2", "x")], "accession string, name string")
    b = spark.createDataFrame([("D-2", "x")], "accession string, candidate string")
    found = {r["accession"]: r["candidate"] for r in names.best_match(a, b, BY).collect()}
    assert found == {"D-1": None, "D-2": "x"}


def test_a_short_name_that_begins_all_others_is_counted(spark):
    a, b = frames(spark, ["s"], [f"s{i}" for i in range(2000)])
    row = names.best_match(a, b, BY).first()
    assert (row["tier"], row["n_matches"], row["candidate"]) == (3, 2000, None)
    assert names.ambiguous(names.best_match(a, b, BY)).count() == 1


def test_ambiguous_columns_are_an_error(spark):
    a, b = frames(spark, ["s"], ["s1", "s2"])
    with pytest.raises(PySparkException, match="several samples"):
        names.match_columns(a, b, BY, keep_unmatched=True).collect()


def test_unmatched_columns(spark):
    a, b = frames(spark, ["gene", "s_1"], ["s-1"])
    kept = names.match_columns(a, b, BY, keep_unmatched=True)
    assert {r["name"]: r["harmonised"] for r in kept.collect()} == {"gene": "gene", "s_1": "s-1"}
    dropped = names.match_columns(a, b, BY, keep_unmatched=False)
    assert {r["name"]: r["harmonised"] for r in dropped.collect()} == {"s_1": "s-1"}


def test_column_order_of_a_rotation(spark):
    """Three columns in rotated order, with an unmatched column between them."""
    original = spark.createDataFrame(
        [("D", c, i) for i, c in enumerate(["s10", "gene", "s2", "s1"])],
        "accession string, name string, place int",
    )
    a, b = frames(spark, ["s10", "gene", "s2", "s1"], ["s1", "s2", "s10"])
    matched = names.match_columns(a, b, BY, keep_unmatched=True)
    ordered = names.column_order(matched, original, BY).orderBy("target").collect()
    assert [r["harmonised"] for r in ordered] == ["s1", "gene", "s2", "s10"]


def test_rename_samples_on_the_row_side(spark):
    rows = spark.createDataFrame(
        [("D", "s_1", 1.0), ("D", "other", 2.0)], "accession string, sample_name string, value double"
    )
    a, b = frames(spark, ["s_1", "other"], ["s-1"])
    matched = names.match_columns(a, b, BY, keep_unmatched=True)
    renamed = names.rename_samples(rows, matched, BY)
    assert {tuple(r) for r in renamed.collect()} == {("D", "s-1", 1.0), ("D", "other", 2.0)}


def test_no_pairs_of_a_group_are_compared(spark):
    a, b = frames(spark, ["x"], ["y"])
    plan = names.best_match(a, b, BY)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    plan = names.all_matches(a, b, BY)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
