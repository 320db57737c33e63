import pytest
from pyspark.sql import functions as F

from assaylens.functions import text
from assaylens.functions.digest import set_fingerprint


def one(spark, value, function):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(function(F.col("v")).alias("r")).first()["r"]


def test_natural_key_orders_digit_runs_as_numbers(spark):
    names = ["b1", "a10", "a9", "A2", "a09", "a", "", "10", "9", "a" + "9" * 30, "a1" + "0" * 30, None]
    df = spark.createDataFrame([(n,) for n in names], "v string")
    ordered = [r["v"] for r in df.orderBy(text.natural_key(F.col("v")).asc_nulls_first(), "v").collect()]
    assert ordered == [
        None, "", "9", "10", "a", "A2", "a09", "a9", "a10", "a" + "9" * 30, "a1" + "0" * 30, "b1",
    ]


@pytest.mark.parametrize(
    "header, field, subfield, extra",
    [
        ("Source Name", "Source Name", None, []),
        ("Characteristics[Age]", "Characteristics", "Age", []),
        ("Characteristics [ sex,http://x/PATO_1,EFO ] ", "Characteristics", "sex", ["http://x/PATO_1", "EFO"]),
        ("Unit", "Unit", None, []),
        ("X[Y]", "X[Y]", None, []),  # one-letter names are not split
    ],
)
def test_headers(spark, header, field, subfield, extra):
    assert one(spark, header, text.header_field) == field
    assert one(spark, header, text.header_subfield) == subfield
    assert one(spark, header, text.header_extra) == extra


def test_percent_encoding_keeps_slashes_and_spaces(spark):
    raw = "a b/c?d=e&f*~+%"
    encoded = one(spark, raw, text.percent_encode)
    assert encoded == "a b/c%3Fd%3De%26f%2A~%2B%25"
    assert one(spark, encoded, text.percent_decode) == raw
    assert one(spark, "50%", text.percent_decode) == "50%"


@pytest.mark.parametrize(
    "value, expected",
    [
        ("1970-01-02", 86400),
        ("1970-01-02 00:00:01", 86401),
        ("1970-01-01T01:00:00+01:00", 0),
        ("1970-01-01T00:00:05Z", 5),
        ("soon", -1),
        (None, -1),
    ],
)
@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_epoch_seconds_do_not_depend_on_the_session(spark, value, expected, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert one(spark, value, text.epoch_seconds) == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize(
    "value, expected",
    [
        (1.0, "1.0"),
        (12345678.0, "12345678.0"),
        (0.000125, "0.000125"),
        (1234567890.25, "1234567890.25"),
        (1e16, "1.0E16"),
        (-2.5e8, "-250000000.0"),
        (None, None),
    ],
)
def test_number_text(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(text.number_text(F.col("v")).alias("r")).first()["r"] == expected


def test_units(spark):
    df = spark.createDataFrame([("36", "day"), ("36", ""), ("36", None), (None, "day")], "v string, u string")
    shown = [r["r"] for r in df.select(text.with_unit(F.col("v"), F.col("u")).alias("r")).collect()]
    assert shown == ["36 {day}", "36", "36", None]


def test_fingerprint_ignores_order_but_not_repeats(spark):
    def fingerprint(rows):
        df = spark.createDataFrame(rows, "a string, b int")
        return df.agg(set_fingerprint(F.col("a"), F.col("b")).alias("f")).first()["f"]

    rows = [("x", 1), ("y", None), ("z", 3)]
    assert fingerprint(rows) == fingerprint(rows[::-1])
    assert fingerprint(rows) != fingerprint(rows + [("x", 1)])
    assert fingerprint(rows) != fingerprint([("x", 1), ("y", 0), ("z", 3)])


def test_collated_order_is_a_readers_order(spark):
    """Punctuation, digits by value, letters; accents after letters, case after accents."""
    ordered = [
        "", "_", "-a", "2", "10", "a", "A", "a b2", "a-b", "a1", "a02", "a10", "ab", "cote", "coté", "côte",
        "e1", "é1", "E2", "é10", "z",
    ]
    df = spark.createDataFrame([(v,) for v in reversed(ordered)], "v string")
    assert [r["v"] for r in df.orderBy(text.collated_key(F.col("v")), "v").collect()] == ordered
