"""Awkward inputs, and plain Python versions of what the operators do."""

from __future__ import annotations

import re
import string

SF = "/root/testdata/sf0.001"
SCHEMA = (
    "doc_id bigint, text string, row bigint, id string, `_row` int, run string, node string, word string, "
    "term string, item string, host string, length int, kind string, n int, `text_` string"
)
LONG = "the quick brown fox jumps over a lazy dog again " * 30_000
TEXTS = [
    (1, "One two three four five six seven eight nine ten eleven"),
    (2, None),
    (3, ""),
    (4, "Same text, twice"),
    (4, "Same text, twice"),
    (5, "SAME TEXT, TWICE"),
    (None, "no identifier here"),
    (6, " \n\t \n"),
    (7, LONG),
    (8, "ünï cödé ß é"),
    (9, None),
]


def awkward(spark, rows=None):
    """Documents with NULLs, repeats, a long text, and columns named like the operators' own."""
    rows = TEXTS if rows is None else rows
    extra = (7, "id", 3, "run", "node", "word", "term", "item", "host", 1, "kind", 2, "text_")
    return spark.createDataFrame([(i, t, *extra) for i, t in rows], SCHEMA)


def lower(text):
    return (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def documents(spark, sf=SF):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
