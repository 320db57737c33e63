"""Scalar text functions, all ``Column -> Column``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The separators that file column names use in place of one another.
NAME_SEPARATORS = r"[._-]"
# How a list written in one text cell is separated.
LIST_SEPARATOR = r"\s*,\s"
# Fixed values: "Field [subfield, extra...]" in a tab header.
HEADER_PATTERN = r"(.+[^\s])\s*\[\s*(.+[^\s])\s*\]\s*$"


def natural_key(text: Column) -> Column:
    """Sort key in which digit runs compare as numbers and letters ignore case.

    A digit run becomes its length followed by its digits, so runs of any
    length compare numerically as plain text.
    """
    runs = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def run_key(run: Column) -> Column:
        digits = F.ltrim(run, F.lit("0"))
        size = F.lpad(F.length(digits).cast("string"), 8, "0")
        return F.when(run.rlike("^[0-9]"), F.concat(size, digits)).otherwise(F.lower(run))

    return F.transform(runs, run_key)


def collated_key(text: Column) -> Column:
    """Sort key of a reader's order: digit runs compare as numbers, all else by Unicode collation.

    Punctuation comes before digits and digits before letters; accents decide only between
    texts that are the same without them, case only between those the same with them. A digit run
    becomes its length and its digits, as in ``natural_key``, inside one text that is
    compared as a whole.
    """
    runs = F.regexp_extract_all(text, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def run_key(run: Column) -> Column:
        digits = F.ltrim(run, F.lit("0"))
        return F.when(run.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 8, "0"), digits)).otherwise(run)

    return F.collate(F.array_join(F.transform(runs, run_key), ""), "UNICODE")


def dotted(name: Column) -> Column:
    """Replace ``.``, ``_`` and ``-`` by a dot, as R does with column names."""
    return F.regexp_replace(name, NAME_SEPARATORS, ".")


def percent_encode(text: Column) -> Column:
    """Percent-encode all but unreserved characters, spaces and slashes."""
    encoded = F.url_encode(text)
    for old, new in (("+", " "), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(old), F.lit(new))
    return encoded


def percent_decode(text: Column) -> Column:
    """Undo percent-encoding; a plus sign stays a plus sign."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def capitalised(text: Column) -> Column:
    """First character upper case, the rest lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**30)))


def label(text: Column) -> Column:
    """Class label without whitespace."""
    return F.regexp_replace(text, r"\s", "_")


def split_id(identifier: Column, parts: int = 3) -> Column:
    """Split ``accession/assay/sample`` at the first slashes only."""
    return F.split(identifier, "/", parts)


def number(text: Column) -> Column:
    """Double, or NULL where the text is not a number."""
    return text.try_cast("double")


def missing_to_null(value: Column) -> Column:
    """Turn a floating-point NaN into NULL, so that min, max and sorting ignore it."""
    return F.when(~F.isnan(value), value)


def as_utc(value: Column) -> Column:
    """Instant of a local time (or naive text) read as UTC, whatever the session's zone."""
    return F.from_utc_timestamp(value.try_cast("timestamp"), F.current_timezone())


def epoch_seconds(text: Column, default: int = -1) -> Column:
    """Unix time of a timestamp text, ``default`` when there is none.

    Text without a zone is UTC.
    """
    zoned = text.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$")
    seconds = F.when(zoned, F.unix_seconds(text.try_cast("timestamp"))).otherwise(
        F.unix_seconds(as_utc(text))
    )
    return F.coalesce(seconds, F.lit(default).cast("bigint"))


def braces(value: Column, unit: Column) -> Column:
    """Default unit format: ``36 {day}``."""
    return F.concat(value, F.lit(" {"), unit, F.lit("}"))


def with_unit(
    value: Column, unit: Column, formatter: Callable[[Column, Column], Column] = braces
) -> Column:
    """Merge a value with its unit when the unit is not empty."""
    return F.when(F.coalesce(F.length(unit), F.lit(0)) > 0, formatter(value, unit)).otherwise(value)


def is_empty(value: Column) -> Column:
    """NULL or empty text."""
    return value.isNull() | (value == "")


def header_field(header: Column) -> Column:
    """Main name of a tab header: ``Characteristics`` of ``Characteristics[Age,uri]``."""
    return F.when(header.rlike(HEADER_PATTERN), F.regexp_extract(header, HEADER_PATTERN, 1)).otherwise(
        header
    )


def _bracketed(header: Column) -> Column:
    inner = F.regexp_extract(header, HEADER_PATTERN, 2)
    return F.when(header.rlike(HEADER_PATTERN), F.split(inner, ","))


def header_subfield(header: Column) -> Column:
    """First item in the brackets of a tab header, NULL without brackets."""
    return F.get(_bracketed(header), F.lit(0))


def header_extra(header: Column) -> Column:
    """Further items in the brackets of a tab header."""
    parts = _bracketed(header)
    return F.coalesce(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array().cast("array<string>"))


def harmonised_key(key: Column) -> Column:
    """Lower-case key without ``$`` and ``.``; ``_id`` is kept apart as ``__id``."""
    plain = F.lower(F.regexp_replace(key, "[$.]", "_"))
    return F.when(plain == "_id", F.lit("__id")).otherwise(plain)


def number_text(value: Column) -> Column:
    """Shortest text of a double, written without an exponent from 1e-4 to 1e16."""
    text = value.cast("double").cast("string")
    size = F.abs(value.cast("double"))
    plain = F.rtrim(text.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    return F.when(text.contains("E") & (size >= 1e-4) & (size < 1e16), plain).otherwise(text)
