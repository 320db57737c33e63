"""Filters on sample annotation and on numeric columns.

A sample row holds its ids in columns and its annotation in ``attrs``, a map from
a dotted path (``study.characteristics.organism``) to a text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.errors import QueryError
from assaylens.functions.text import number

# The fields that may be constrained, by category.
FIELDS = {
    "id": {"accession", "assay name", "sample name", "study name"},
    "investigation": {"investigation", "study", "study assays"},
    "study": {"characteristics", "factor value", "parameter value"},
    "assay": {"characteristics", "factor value", "parameter value"},
    "file": {"datatype", "filename"},
}
DEPTH = {"id": 1, "investigation": 2, "study": 2, "assay": 2, "file": 1}
ANNOTATION = ("investigation", "study", "assay")


@dataclass(frozen=True)
class Predicate:
    """A condition on a sample (or on one of its files) and the paths it names."""

    condition: Callable[[], Column]
    paths: tuple[str, ...] = ()
    on_files: bool = False


@dataclass(frozen=True)
class IdSelection:
    """Samples below any of the given ``accession[/assay[/sample]]`` ids."""

    ids: tuple[tuple[str, ...], ...]
    paths: tuple[str, ...] = ()


def check_path(path: str, *, block: bool = False) -> tuple[str, list[str]]:
    """Split a dotted path and check its category, field and depth."""
    category, *fields = path.split(".")
    if category not in FIELDS:
        raise QueryError(f"unrecognised category in {path!r}")
    if not fields or not all(fields):
        raise QueryError(f"category {category!r} requires a field: {path!r}")
    if fields[0] not in FIELDS[category]:
        raise QueryError(f"unrecognised field in {path!r}")
    if len(fields) > DEPTH[category]:
        raise QueryError(f"too many nested fields in {path!r}")
    if block and (category not in ANNOTATION or len(fields) != 1):
        raise QueryError(f"{path!r} is not a block of fields")
    return category, fields


def value_of(path: str) -> Column:
    """The value at a path of a sample row (of its unnested file for ``file.*``)."""
    category, fields = check_path(path)
    if category == "id":
        return F.col(fields[0].replace(" ", "_"))
    if category == "file":
        return F.col("file").getField(fields[0])
    if len(fields) == 1:
        raise QueryError(f"{path!r} is a block of fields, not a single field")
    return F.col("attrs").getItem(path)


def _predicate(path: str, make: Callable[[Column], Column]) -> Predicate:
    value_of(path)  # argument check
    return Predicate(lambda: make(value_of(path)), (path,), path.startswith("file."))


def isin(path: str, values: Iterable[str]) -> Predicate:
    """The field equals one of the values."""
    wanted = list(values)
    return _predicate(path, lambda c: c.isin(wanted))


def eq(path: str, value: str) -> Predicate:
    """The field equals the value; ``a|b|c`` lists alternatives."""
    return isin(path, value.split("|"))


def matches(path: str, pattern: str) -> Predicate:
    """The regular expression occurs in the field (unanchored, case-sensitive)."""
    return _predicate(path, lambda c: c.rlike(pattern))


def exists(path: str) -> Predicate:
    """The field is present."""
    return _predicate(path, lambda c: c.isNotNull())


def any_exists(block: str, names: Sequence[str]) -> Predicate:
    """At least one of several sibling fields is present."""
    paths = tuple(f"{block}.{name}" for name in names)
    if not paths:
        raise QueryError("at least one field is needed")
    for path in paths:
        value_of(path)
    return Predicate(
        lambda: reduce(lambda a, b: a | b, [value_of(p).isNotNull() for p in paths]),
        paths,
        block.startswith("file"),
    )


def block_exists(block: str) -> Predicate:
    """Any field of the block (``study.characteristics``) is present."""
    check_path(block, block=True)
    return Predicate(
        lambda: F.exists(F.map_keys("attrs"), lambda k: k.startswith(f"{block}.")), (block,)
    )


def by_id(*ids: str) -> IdSelection:
    """Samples below any id ``accession[/assay[/sample]]``; ``|`` lists alternatives."""
    parts = tuple(tuple(i.split("/", 2)) for text in ids for i in text.split("|"))
    if not parts:
        raise QueryError("at least one id is needed")
    return IdSelection(parts)


def _select_ids(df: DataFrame, selection: IdSelection) -> DataFrame:
    """Rows below a listed id, however many ids are listed.

    The accessions prune the scan; the ids of each depth are then one set that a row's
    own id is looked up in. The separator cannot be typed, so ids are told apart safely,
    and a part that is NULL is in no set.
    """
    names = ("accession", "assay_name", "sample_name")
    by_depth: dict[int, set[str]] = {}
    for parts in selection.ids:
        by_depth.setdefault(len(parts), set()).add("\x1f".join(parts))

    def own(depth: int) -> Column:
        parts = [F.col(n) for n in names[:depth]]
        return F.concat(*[x for p in parts for x in (F.lit("\x1f"), p)][1:])

    listed = [own(depth).isin(sorted(ids)) for depth, ids in sorted(by_depth.items())]
    accessions = sorted({parts[0] for parts in selection.ids})
    return df.filter(F.col("accession").isin(accessions)).filter(reduce(lambda a, b: a | b, listed))


def filter_samples(df: DataFrame, predicates: Iterable[Predicate | IdSelection]) -> DataFrame:
    """Keep the samples that satisfy all predicates.

    When a predicate names a file, files are unnested first (one row per sample
    and file, in the struct column ``file``), so it also selects the files.
    """
    chosen = list(predicates)
    on_files = [p for p in chosen if isinstance(p, Predicate) and p.on_files]
    for item in chosen:
        if isinstance(item, IdSelection):
            df = _select_ids(df, item)
        elif not item.on_files:
            df = df.filter(item.condition())
    if on_files:
        if "file" not in df.columns:
            df = unnest_files(df)
        for item in on_files:
            df = df.filter(item.condition())
    return df


def unnest_files(df: DataFrame) -> DataFrame:
    """One row per sample and file; samples without files drop out."""
    return df.withColumn("file", F.explode("files")).drop("files")


# --- numeric comparisons on data columns -------------------------------------------

_COMPARE: dict[str, Callable[[Column, float], Column]] = {
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    "=": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    ">=": lambda c, v: c >= v,
    ">": lambda c, v: c > v,
}


@dataclass(frozen=True)
class Comparison:
    """``column operator number`` on a data table."""

    column: str
    operator: str
    value: float


def compare(column: str, operator: str, value: object) -> Comparison:
    """Check and build a comparison of a column with a number."""
    if operator not in _COMPARE:
        raise QueryError(f"unsupported comparison {operator!r}")
    try:
        return Comparison(column, operator, float(value))  # type: ignore[arg-type]
    except (TypeError, ValueError):
        raise QueryError(f"only comparisons to numbers are supported, not {value!r}") from None


def comparison_column(df: DataFrame, column: str, operator: str, value: float) -> Column:
    """The condition itself; text that is not a number never matches."""
    field = F.col(f"`{column}`")
    if df.schema[column].dataType.typeName() not in ("double", "float", "integer", "long"):
        field = number(field.cast("string"))
    return _COMPARE[operator](field, value)
