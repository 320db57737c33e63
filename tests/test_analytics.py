import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaylens.operators import analytics

SCHEMA = "accession string, assay_name string, sample_name string, feature string, value double"


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(3)
    data = rng.poisson(8, size=(12, 5)).astype(float)
    data[3] = 4.0  # a feature without any variation
    return pd.DataFrame(data, index=[f"g{i}" for i in range(12)], columns=[f"s{i}" for i in range(5)])


def long_of(spark, wide):
    rows = [("D", "x", s, f, float(wide.loc[f, s])) for f in wide.index for s in wide.columns]
    return spark.createDataFrame(rows, SCHEMA)


def wide_of(df, like):
    out = pd.DataFrame(np.nan, index=like.index, columns=like.columns)
    for r in df.collect():
        out.loc[r["feature"], r["sample_name"]] = np.nan if r["value"] is None else r["value"]
    return out


def test_normalise_log_and_z_score_as_in_pandas(spark, wide):
    df = long_of(spark, wide)
    expected = np.log(1e-6 + wide / wide.mean())
    logged = analytics.log_value(analytics.normalise(df), 1e-6)
    pd.testing.assert_frame_equal(wide_of(logged, wide), expected)
    z = expected.sub(expected.mean(axis=1), axis=0).div(expected.std(axis=1), axis=0)
    pd.testing.assert_frame_equal(wide_of(analytics.z_score(logged), wide), z)
    ten = np.log10(0.1 + wide)
    pd.testing.assert_frame_equal(wide_of(analytics.log_value(df, 0.1, 10), wide), ten)
    top = analytics.most_variable(df, 4)
    by_std = wide.std(axis=1).sort_values(ascending=False, kind="stable")
    assert {r["feature"] for r in top.collect()} == set(by_std.index[:4])
    assert analytics.keep_features(df, top).count() == 4 * 5
    assert analytics.largest_magnitude(df).first()["vmax"] == wide.abs().max().max()


def test_zero_mean_and_constant_features_give_null(spark):
    df = spark.createDataFrame([("D", "x", "s", "g", 0.0), ("D", "x", "s", "h", 0.0)], SCHEMA)
    assert {r["value"] for r in analytics.normalise(df).collect()} == {None}
    assert {r["value"] for r in analytics.z_score(df).collect()} == {None}


def test_missing_values(spark):
    df = spark.createDataFrame([("a", 1.5, None), ("b", 2.5, 3.0)], "f string, x double, y double")
    assert [r["f"] for r in analytics.complete_rows(df, "f").collect()] == ["b"]
    assert analytics.filled_rows(df, "f").orderBy("f").first()["y"] == 0.0
    assert [tuple(r) for r in analytics.rounded(df, "f").orderBy("f").collect()] == [("a", 2.0, None), ("b", 2.0, 3.0)]
    long = spark.createDataFrame(
        [("D", "x", "s1", "g", 1.0), ("D", "x", "s2", "g", 1.0), ("D", "x", "s1", "h", 1.0), ("D", "x", "s2", "h", None)],
        SCHEMA,
    )
    assert {r["feature"] for r in analytics.complete_features(long, 2).collect()} == {"g"}


def test_significance(spark):
    rows = [("a", 0.01, 3.0), ("b", 0.01, -2.5), ("c", 0.2, 9.0), ("d", None, 9.0), ("e", 0.01, 2.0)]
    df = spark.createDataFrame(rows, "gene string, padj double, log2FoldChange double")
    flagged = analytics.significance(df)
    got = {r["gene"]: r for r in flagged.collect()}
    assert math.isclose(got["a"]["neg_log10_p"], 2.0) and got["d"]["neg_log10_p"] == 0
    assert [r["gene"] for r in analytics.significant_rows(flagged).collect()] == ["b", "a"]
    assert analytics.significant_rows(flagged).columns == df.columns


def test_recoding(spark):
    df = spark.createDataFrame([("Ground Control",), ("liver",)], "v string")
    row = df.select(
        analytics.factor_level(F.col("v")).alias("l"),
        analytics.recode(F.col("v"), {"Ground Control": "grey"}).alias("c"),
        analytics.batch_label(F.lit("GLDS-1")).alias("b"),
    ).collect()
    assert [tuple(r) for r in row] == [("Ground.Control", "grey", "GLDS_1"), ("liver", None, "GLDS_1")]


@pytest.mark.parametrize(
    "names, expected",
    [
        (["a", "b", "a", "a"], ["a", "b", "a.1", "a.2"]),
        (["a", "a", "a.1"], ["a", "a.2", "a.1"]),
        (["a.2", "a", "a", "a", "a.1", "a.1"], ["a.2", "a", "a.3", "a.4", "a.1", "a.1.1"]),
        (["x.1", "x.3", "x", "x", "x", "x"], ["x.1", "x.3", "x", "x.2", "x.4", "x.5"]),
    ],
)
def test_unique_names(spark, names, expected):
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    out = analytics.make_unique(df, "n", ["i"]).orderBy("i").collect()
    assert [r["unique_name"] for r in out] == expected


def test_design_matrix(spark):
    meas = spark.createDataFrame([("D-1", "x", "s1", "g", 1.0), ("D-1", "x", "s1", "h", 1.0)], SCHEMA)
    annotation = spark.createDataFrame(
        [("D-1", "x", "s1", "Space Flight"), ("D-1", "x", "s2", "no")],
        "accession string, assay_name string, sample_name string, flight string",
    )
    rows = analytics.design_matrix(meas, annotation, {"flight": analytics.factor_level(F.col("flight"))})
    assert [tuple(r) for r in rows.collect()] == [("D-1/x/s1", "D_1", "Space.Flight")]
