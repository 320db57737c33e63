import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assaylens.errors import DataError, QueryError
from assaylens.operators import profile, tables
from assaylens.operators.predicates import compare
from assaylens.session import scratch_path


def frame(spark, index, columns, rows):
    schema = ", ".join([f"{index} string", *[f"{c} double" for c in columns]])
    return spark.createDataFrame(rows, schema)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, v) for v in r))


def brute_force_outer_join(tables_rows, widths):
    """Left fold of full outer joins on the first cell, duplicates removed."""
    result = {tuple(r) for r in tables_rows[0]}
    width = widths[0]
    for rows, w in zip(tables_rows[1:], widths[1:]):
        rows = {tuple(r) for r in rows}
        out = set()
        for left in result:
            hits = [r for r in rows if left[0] is not None and r[0] == left[0]]
            out.update(left + r[1:] for r in hits) if hits else out.add(left + (None,) * w)
        for right in rows:
            if right[0] is None or all(right[0] != left[0] for left in result):
                out.add((right[0],) + (None,) * width + right[1:])
        result, width = out, width + w
    return result


def test_outer_join_matches_brute_force(spark):
    rng = random.Random(1)
    keys = ["a", "b", "c", "d", "e", None]
    made = [
        [(rng.choice(keys), *[rng.choice([1.0, 2.0, None]) for _ in range(w)]) for _ in range(12)]
        for w in (1, 2, 1)
    ]
    # rows without an index and without any value are not told apart by table
    made = [[r for r in rows if any(v is not None for v in r)] for rows in made]
    frames = [
        frame(spark, "k", [f"c{i}_{j}" for j in range(w)], rows)
        for i, (w, rows) in enumerate(zip((1, 2, 1), made))
    ]
    joined = tables.outer_join(frames, "k")
    got = [tuple(r) for r in joined.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_force_outer_join(made, (1, 2, 1))


@pytest.mark.parametrize("seed", range(3))
def test_many_tables_match_brute_force(spark, seed):
    """Some tables repeat index values, some do not; cells are numbers and texts."""
    rng = random.Random(seed)
    keys = ["a", "b", "c", "d", "e"]
    made, frames = [], []
    for i in range(7):
        chosen = [rng.choice(keys) for _ in range(8)] if i in (1, 4) else rng.sample(keys, rng.randint(0, 5))
        chosen += [None] if i % 3 == 0 else []
        rows = [(k, rng.choice([1.0, 2.0]), rng.choice(["x", None])) for k in chosen]
        made.append(rows)
        frames.append(spark.createDataFrame(rows, f"k string, n{i} double, `s.{i}` string"))
    assert tables.repeating_tables(frames, "k") == [i for i, rows in enumerate(made) if len({r[0] for r in rows}) < len(rows)]
    joined = tables.outer_join_many(frames, "k")
    assert joined.columns == ["k", *[c for i in range(7) for c in (f"n{i}", f"s.{i}")]]
    got = [tuple(r) for r in joined.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_force_outer_join(made, (2,) * 7)


def test_two_hundred_tables_in_one_shuffle(spark):
    rng = random.Random(4)
    made = [{f"g{g}": float(g * i) for g in rng.sample(range(30), 10)} for i in range(200)]
    rows = spark.createDataFrame([(i, k, v) for i, t in enumerate(made) for k, v in t.items()], "t int, k string, v double")
    path = scratch_path(spark, "many")
    rows.write.partitionBy("t").parquet(path)
    frames = [spark.read.schema("k string, v double").parquet(f"{path}/t={i}").toDF("k", f"v{i}") for i in range(200)]
    joined = tables.outer_join_many(frames, "k", unique=True)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {r["k"]: tuple(r)[1:] for r in joined.collect()}
    assert got == {f"g{g}": tuple(t.get(f"g{g}") for t in made) for g in range(30) if any(f"g{g}" in t for t in made)}


def test_presence_of_more_tables_than_a_number_has_bits(spark):
    made = [{f"g{i}", f"g{i % 7}"} for i in range(130)]
    frames = [frame(spark, "k", [f"x{i}"], [(k, 1.0) for k in [*sorted(keys), None]]) for i, keys in enumerate(made)]
    presence = tables.index_presence(frames, "k")
    assert "collect_set" not in presence._jdf.queryExecution().toString()
    held = [tables.is_present(i).alias(f"t{i}") for i in range(130)]
    got = {(r["k"], r["_home"]): list(r)[2:] for r in presence.select("k", "_home", *held).collect()}
    assert got.keys() == {(k, -1) for keys in made for k in keys} | {(None, i) for i in range(130)}
    for (k, home), found in got.items():
        assert found == [home == i if k is None else k in keys for i, keys in enumerate(made)]


def test_many_tables_never_lose_a_repeated_value(spark):
    a = frame(spark, "k", ["x"], [("g", 1.0), ("g", 2.0)])
    b = frame(spark, "k", ["y"], [("g", 5.0)])
    with pytest.raises(PySparkException):
        tables.outer_join_many([a, b], "k", unique=True).collect()
    with pytest.raises(QueryError):
        tables.outer_join_many([a, a], "k")
    assert rows_of(tables.outer_join_many([a], "k")) == [("g", 1.0), ("g", 2.0)]


def test_outer_join_multiplies_a_repeated_index_once_per_distinct_row(spark):
    a = frame(spark, "k", ["x"], [("g", 1.0), ("g", 1.0), ("g", 2.0), ("h", 3.0)])
    b = frame(spark, "k", ["y"], [("g", 5.0), ("g", 6.0), ("i", 7.0)])
    assert rows_of(tables.outer_join([a, b], "k")) == [
        ("g", 1.0, 5.0), ("g", 1.0, 6.0), ("g", 2.0, 5.0), ("g", 2.0, 6.0),
        ("h", 3.0, None), ("i", None, 7.0),
    ]


def test_outer_join_with_a_hot_index_value(spark):
    """A third of all rows share one index value."""
    hot = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"),
        F.col("id").cast("double").alias("x"),
    )
    other = frame(spark, "k", ["y"], [("hot", 1.0), ("k1", 2.0), ("new", 3.0)])
    joined = tables.outer_join([hot, other], "k")
    assert joined.count() == 30_001
    assert joined.filter("k = 'hot' AND y = 1.0").count() == 10_000


def test_wide_and_long_joins_agree_for_a_unique_index(spark):
    a = frame(spark, "feature", ["x", "y"], [("g1", 1.0, 2.0), ("g2", None, 3.0)])
    b = frame(spark, "feature", ["z"], [("g2", 4.0), ("g3", 5.0)])
    wide = tables.outer_join([a, b], "feature")
    long = tables.to_long(a, "feature").unionByName(tables.to_long(b, "feature"))
    pivoted = tables.pivot_long(long, "feature", "name", "value", ["x", "y", "z"])
    assert rows_of(wide) == rows_of(pivoted)


def test_repeated_index_values_are_kept_or_an_error(spark):
    long = spark.createDataFrame(
        [("g", "x", 5.0), ("g", "x", 1.0), ("g", "y", 2.0), ("h", "y", 3.0), ("h", "y", 3.0)],
        "feature string, name string, value double",
    )
    wide = tables.pivot_long(long, "feature", "name", "value", ["x", "y"], repeated=True)
    assert rows_of(wide) == [("g", 1.0, 2.0), ("g", 5.0, None), ("h", None, 3.0), ("h", None, 3.0)]
    with pytest.raises(PySparkException, match="repeated"):
        tables.pivot_long(long, "feature", "name", "value", ["x", "y"]).collect()


def test_index_names_must_agree(spark):
    a, b = frame(spark, "k", ["x"], []), frame(spark, "j", ["y"], [])
    with pytest.raises(QueryError):
        tables.outer_join([a, b], "k")


def test_column_resolution(spark):
    a = tables.qualify(frame(spark, "k", ["x", "y"], [("g", 1.0, 2.0)]), "k", "D-1", "rna")
    b = tables.qualify(frame(spark, "k", ["x"], [("g", 3.0)]), "k", "D-2", "rna")
    joined = tables.outer_join([a, b], "k")
    assert joined.columns == ["k", "D-1/rna/x", "D-1/rna/y", "D-2/rna/x"]
    assert tables.select_columns(joined, "k", ["D-2/rna/x", "y"]).columns == ["k", "D-2/rna/x", "D-1/rna/y"]
    with pytest.raises(QueryError, match="several datasets"):
        tables.select_columns(joined, "k", ["x"])
    with pytest.raises(QueryError, match="no column"):
        tables.select_columns(joined, "k", ["w"])
    assert tables.header_levels("D-1/rna/a/b") == ("D-1", "rna", "a/b")
    assert tables.header_levels("x") == ("x", "*", "*")


def test_comparisons(spark):
    df = spark.createDataFrame([("a", "10"), ("b", "x"), ("c", None), ("d", "9.5")], "k string, v string")
    kept = tables.where(df, "k", [compare("v", ">", "9")])
    assert [r["k"] for r in kept.orderBy("k").collect()] == ["a", "d"]
    for bad in (("v", "!=", 1), ("v", "<", "many"), ("v", "<", None)):
        with pytest.raises(QueryError):
            compare(*bad)


def test_page_needs_a_limit_for_an_offset(spark):
    df = frame(spark, "k", ["x"], [(f"g{i}", float(i)) for i in range(12)])
    assert [r["k"] for r in tables.page(df, "k", 3, 8).collect()] == ["g8", "g9", "g10"]
    with pytest.raises(QueryError):
        tables.page(df, "k", None, 5)


FILES = "accession string, datatype string, technology string, joinable boolean, type string, index_name string"
GOOD = ("D-1", "counts", "rna", True, "table", None)


@pytest.mark.parametrize(
    "other, message",
    [
        (("D-2", "pca", "rna", True, "table", None), "several datatypes"),
        (("D-2", None, "rna", True, "table", None), "several datatypes"),
        (("D-2", "counts", "array", True, "table", None), "several technologies"),
        (("D-2", "counts", "rna", None, "table", None), "of this datatype"),
        (("D-2", "counts", "rna", True, None, None), "only tables"),
        (("D-2", "counts", "rna", True, "table", "sample name"), "indexed by different"),
    ],
)
def test_joinability(spark, other, message):
    with pytest.raises(DataError, match=message):
        tables.check_joinable(spark.createDataFrame([GOOD, other], FILES))
    tables.check_joinable(spark.createDataFrame([GOOD, GOOD], FILES))
    tables.check_joinable(spark.createDataFrame([other], FILES))  # a single file always passes


def descriptions(df):
    return {r["column"]: r["description"] for r in df.collect()}


def test_profile_descriptions(spark):
    df = spark.createDataFrame(
        [("a", 1, 1.5, True, None, float("nan")), ("b", None, 2.0, False, None, 1.0)],
        "k string, i int, x double, b boolean, empty double, n double",
    )
    assert descriptions(profile.profile(df)) == {
        "k": "str[..]",
        "i": "float[(1.0)..(1.0)|NaN]",
        "x": "float[(1.5)..(2.0)]",
        "b": "bool[(False)..(True)]",
        "empty": "float[(NaN)..(NaN)|NaN]",
        "n": "float[(1.0)..(1.0)|NaN]",
    }
    whole = spark.createDataFrame([(1, "x"), (5, None)], "i int, s string")
    assert descriptions(profile.profile(whole)) == {"i": "int[(1)..(5)]", "s": "str[..|NaN]"}
    assert set(descriptions(profile.profile(whole.limit(0))).values()) == {"NaN"}


@pytest.mark.parametrize("seed", range(3))
def test_profile_before_and_after_the_join_agree(spark, seed):
    rng = random.Random(seed)
    frames = []
    for i in range(3):
        keys = rng.sample("abcdefgh", 3 + 2 * i if seed else 8)
        rows = [(k, rng.choice([None, 1.0, 2.5]), float(rng.randrange(9))) for k in keys]
        frames.append(frame(spark, "k", [f"u{i}", f"v{i}"], rows))
    after = descriptions(profile.profile(tables.outer_join(frames, "k")))
    assert descriptions(profile.profile_outer_join(frames, "k")) == after


def test_shape(spark):
    df = frame(spark, "k", ["x", "y"], [("a", 1.0, 2.0)])
    assert tuple(profile.shape(df, ["k"]).first()) == (1, 2)




def test_long_rows_meet_by_feature_before_they_are_wide(spark):
    long = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 2.0), ("y", "a", 3.0)], "f string, n string, v double")
    wide = tables.pivot_long(long, "f", "n", "v", ["a", "b"])
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(f" in plan
    assert sorted(map(tuple, wide.collect())) == [("x", 1.0, 2.0), ("y", 3.0, None)]
