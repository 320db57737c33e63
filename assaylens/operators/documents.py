"""Nested documents of samples: values with what describes them, as VARIANT columns.

The flat annotation map has one text for each field. A document keeps all of it: below a
value its unit, term, protocol and comments, below a record its comments. Its form is

* ``assay`` and ``study``: ``field -> subfield -> {"": value, "unit", "term accession number",
  "protocol ref", "comment": {name: value}, ...}``; a field without a subfield is a list of
  such objects, one for each of its columns;
* ``investigation``: ``section -> {key: value, "comment": {name: value}}`` of the records of
  the assay, its study and the investigation.

Keys are harmonised as in dotted paths, but for the names of comments, which stay as they
are spelled. What is empty is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.functions.text import LIST_SEPARATOR, harmonised_key, is_empty

DEPTH = 5  # levels of objects in a document: category, field, subfield, attribute, comment
COMMENT = "comment"


def _object(entries: Column) -> Column:
    """The object of an array of (key, value) entries, without those that have no value."""
    return F.to_variant_object(F.map_from_entries(F.filter(entries, lambda e: e.getField("value").isNotNull())))


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _texts(named: Column) -> Column:
    """The object of a map of texts without empty ones; NULL if there are none."""
    filled = F.map_filter(named, lambda _, v: ~is_empty(v))
    return F.when(F.size(filled) > 0, F.to_variant_object(filled))


def field_object(field: Column) -> Column:
    """A value and what describes it, of one entry of ``fields`` (see ``isa.read_fields``)."""

    def text(name: str) -> Column:
        value = field.getField(name)
        return F.when(~is_empty(value), value.cast("variant"))

    own = F.array(
        _entry(F.lit(""), text("value")),
        _entry(F.lit("unit"), text("unit")),
        _entry(F.lit("term accession number"), text("term")),
        _entry(F.lit("protocol ref"), text("protocol_ref")),
        _entry(F.lit(COMMENT), _texts(field.getField("comment"))),
        _entry(F.lit("references"), _texts(field.getField("references"))),
    )
    return _object(own)


def branches(layout: Column) -> Column:
    """(name, below, alone) for each key of the documents of a tab: the entries of its ``layout``
    with a subfield, each as (key, entry), and those without one. It is worked out once per tab."""

    def key(entry: Column) -> Column:
        return harmonised_key(entry.getField("field"))

    def branch(name: Column) -> Column:
        own = F.filter(layout, lambda e: key(e) == name)
        below = F.filter(own, lambda e: e.getField("subfield").isNotNull())
        named = F.transform(below, lambda e: F.struct(harmonised_key(e.getField("subfield")).alias("key"), e.alias("entry")))
        return F.struct(name.alias("name"), named.alias("below"), own.alias("alone"))

    return F.transform(F.array_distinct(F.transform(layout, key)), branch)


def text_places(tab_branches: Column) -> Column:
    """The positions of all cells that ``leaves`` finds in the document of a row, of its ``branches``:
    those of entries with a subfield, as others are lists."""

    def places(named: Column) -> Column:
        entry = named.getField("entry")
        own = F.array(*[entry.getField(c) for c in ("pos", "unit_pos", "term_pos", "ref_pos")])
        return F.concat(own, entry.getField("comments").getField("places"), entry.getField("references").getField("places"))

    found = F.flatten(F.transform(tab_branches, lambda b: F.flatten(F.transform(b.getField("below"), places))))
    return F.array_distinct(F.filter(found, lambda p: p.isNotNull()))


def row_document(tab_branches: Column, read: Callable[[Column], Column]) -> Column:
    """The document of a tab row: field -> subfield -> object, or field -> list of objects.

    ``read`` gives what a row holds for an entry, with the fields of ``isa.read_fields``.
    """

    def described(entry: Column) -> Column:
        return field_object(read(entry))

    def branch(b: Column) -> Column:
        below = b.getField("below")
        named = _object(F.transform(below, lambda e: _entry(e.getField("key"), described(e.getField("entry")))))
        listed = F.to_variant_object(F.transform(b.getField("alone"), described))
        return _entry(b.getField("name"), F.when(F.size(below) > 0, named).otherwise(listed))

    return _object(F.transform(tab_branches, branch))


def record_document(content: Column, comments: Column) -> Column:
    """The document of an investigation record: its keys, and its comments below one of their own.

    ``comments`` is an array of (comment, values), as ``isa.fold_comments`` gives them: a
    single value is a text, several are a list.
    """
    kept = F.filter(F.map_entries(content), lambda e: ~is_empty(e.getField("value")))
    plain = F.transform(kept, lambda e: _entry(harmonised_key(e.getField("key")), e.getField("value").cast("variant")))

    def folded(comment: Column) -> Column:
        values = F.filter(comment.getField("values"), lambda v: ~is_empty(v))
        one = F.get(values, F.lit(0)).cast("variant")
        several = F.to_variant_object(values)
        return _entry(comment.getField("comment"), F.when(F.size(values) == 1, one).when(F.size(values) > 1, several))

    below = F.filter(F.transform(comments, folded), lambda e: e.getField("value").isNotNull())
    named = F.when(F.size(below) > 0, _object(below))
    return _object(F.concat(plain, F.array(_entry(F.lit(COMMENT), named))))


def sample_document(assay: Column, study: Column, records: dict[str, Column]) -> Column:
    """The document of a sample, of those of its rows and of the records by their sections."""
    sections = F.array(*[_entry(F.lit(section.lower()), document) for section, document in records.items()])
    return _object(
        F.array(
            _entry(F.lit("assay"), assay),
            _entry(F.lit("study"), study),
            _entry(F.lit("investigation"), _object(sections)),
        )
    )


def value_at(path: Sequence[str], document: str = "document") -> Column:
    """The text at a path of keys; the value itself where the path ends at a described value."""
    steps = "".join("['{}']".format(k.replace("\\", "\\\\").replace("'", "\\'")) for k in path)
    # where the path ends at an object, its text is what stands below the empty key
    return F.coalesce(
        F.try_variant_get(F.col(document), f"${steps}['']", "string"),
        F.when(
            ~F.schema_of_variant(F.try_variant_get(F.col(document), f"${steps}", "variant")).startswith("OBJECT"),
            F.try_variant_get(F.col(document), f"${steps}", "string"),
        ),
    )


def leaves(df: DataFrame, keep: Sequence[str], document: str = "document") -> DataFrame:
    """(keep..., path, value): the texts of documents, with the keys that lead to them.

    Objects are exploded level by level, without a shuffle; lists are not looked into, as
    their items are not part of the annotation proper.
    """
    start = F.array().cast("array<string>").alias("_path")
    level = df.where(F.col(document).isNotNull()).select(*keep, start, F.col(document).alias("_value"))
    inner = F.col("_key").isNotNull()
    for _ in range(DEPTH):
        # of lists and texts this is NULL; what an object is like below is not looked at
        entries = F.try_variant_get("_value", "$", "map<string, variant>")
        level = level.select(*keep, "_path", "_value", F.explode_outer(entries).alias("_key", "_below")).select(
            *keep,
            F.when(inner, F.array_append("_path", F.col("_key"))).otherwise(F.col("_path")).alias("_path"),
            F.when(inner, F.col("_below")).otherwise(F.col("_value")).alias("_value"),
        )
    # the items of a list need no look to tell that it is no text
    listed = F.try_variant_get("_value", "$", "array<variant>").isNotNull()
    texts = level.where(F.when(listed, False).otherwise(F.schema_of_variant("_value") == "STRING"))
    return texts.select(*keep, F.col("_path").alias("path"), F.try_variant_get("_value", "$", "string").alias("value"))


def leaf_items(df: DataFrame, keep: Sequence[str], document: str = "document") -> DataFrame:
    """(keep..., item): the distinct items of all texts, which may be lists."""
    return listed_items(df, keep, document).distinct()


def listed_items(df: DataFrame, keep: Sequence[str], document: str = "document") -> DataFrame:
    """``leaf_items`` as they stand, repeats included."""
    found = leaves(df, keep, document)
    return found.select(*keep, F.explode(F.split("value", LIST_SEPARATOR)).alias("item"))
