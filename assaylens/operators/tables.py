"""Wide data tables: column names, selection, row filters, limits, joins on the index.

A wide table has one index column and columns named ``accession/assay/column``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from assaylens.errors import DataError, QueryError
from assaylens.operators.order import natural_order
from assaylens.operators.predicates import Comparison, comparison_column
from assaylens.operators.ranking import join_back, with_position

_WORD = 62  # tables whose bits share a number


def qualify(df: DataFrame, index: str, accession: str, assay: str) -> DataFrame:
    """Name the data columns ``accession/assay/column``."""
    return df.select(
        F.col(f"`{index}`"),
        *[F.col(f"`{c}`").alias(f"{accession}/{assay}/{c}") for c in df.columns if c != index],
    )


def header_levels(name: str) -> tuple[str, str, str]:
    """The three header levels of a data column; a missing level is ``*``.

    A column name may itself hold slashes, accessions and assays cannot.
    """
    accession, _, rest = name.partition("/")
    assay, _, column = rest.partition("/")
    return accession, assay or "*", column or "*"


def resolve(columns: Sequence[str], index: str, name: str) -> str:
    """Full name of a requested column: as given, or a raw last level that is unique."""
    if name in columns:
        return name
    raw = Counter(c.split("/", 2)[-1] for c in columns if c != index)
    if raw[name] == 0:
        raise QueryError(f"no column {name!r} in the joined table; list its columns to choose from")
    if raw[name] > 1:
        raise QueryError(f"several datasets have a column {name!r}; write accession/assay/column")
    return next(c for c in columns if c != index and c.split("/", 2)[-1] == name)


def select_columns(df: DataFrame, index: str, names: Sequence[str]) -> DataFrame:
    """Keep the index and the requested columns, in the order of the request."""
    if not names:
        return df
    chosen = list(dict.fromkeys(resolve(df.columns, index, n) for n in names))
    return df.select(*[F.col(f"`{c}`") for c in [index, *[c for c in chosen if c != index]]])


def where(df: DataFrame, index: str, comparisons: Iterable[Comparison]) -> DataFrame:
    """Keep the rows that satisfy all comparisons; NULL never does."""
    for item in comparisons:
        name = resolve(df.columns, index, item.column)
        df = df.filter(comparison_column(df, name, item.operator, item.value))
    return df


def page(df: DataFrame, index: str, limit: int | None, offset: int = 0) -> DataFrame:
    """``limit`` rows after the first ``offset``, in natural order of the index."""
    if limit is None:
        if offset:
            raise QueryError("an offset needs a limit")
        return df
    rest = [F.col(f"`{c}`").asc_nulls_first() for c in df.columns if c != index]
    return df.orderBy(*natural_order([index]), *rest).offset(offset).limit(limit)


def fill_missing(df: DataFrame, na_rep: str, keep: Sequence[str] = ()) -> DataFrame:
    """All columns but ``keep`` as text, with ``na_rep`` in place of NULL."""
    return df.select(
        *[
            F.col(f"`{c}`")
            if c in keep
            else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(na_rep)).alias(c)
            for c in df.columns
        ]
    )


# --- joins --------------------------------------------------------------------------


def check_same_index(tables: Sequence[DataFrame], index: str) -> None:
    """All tables must have the index, and no other column in common."""
    if len(tables) < 1:
        raise QueryError("no tables to join")
    seen: set[str] = set()
    for table in tables:
        if index not in table.columns:
            raise QueryError(f"every table to be joined needs the index {index!r}")
        clash = seen.intersection(table.columns)
        if clash:
            raise QueryError(f"columns occur in more than one table: {sorted(clash)}")
        seen.update(c for c in table.columns if c != index)


def _with_home(table: DataFrame, index: str, number: int) -> DataFrame:
    """Mark rows without an index by their table, so that they match no other row."""
    return table.withColumn(
        "_home", F.when(F.col(f"`{index}`").isNull(), F.lit(number)).otherwise(F.lit(-1))
    )


def index_presence(tables: Sequence[DataFrame], index: str) -> DataFrame:
    """Which tables hold each index value: (index, _home, present ARRAY<BIGINT>).

    ``present`` has a bit for each table, ``_WORD`` of them to a number. The index is read alone
    and combined before the shuffle, so a value repeated in most rows costs one row per map task.
    """
    n_words = (len(tables) - 1) // _WORD + 1
    keys = []
    for i, t in enumerate(tables):
        words = [F.lit(1 << i % _WORD if w == i // _WORD else 0).cast("bigint").alias(f"_word{w}") for w in range(n_words)]
        keys.append(_with_home(t.select(F.col(f"`{index}`")), index, i).select(F.col(f"`{index}`"), "_home", *words))
    grouped = _union(keys).groupBy(f"`{index}`", "_home")
    # numbers are combined in place, where sets of tables are objects that are sorted before they meet
    met = grouped.agg(*[F.bit_or(f"_word{w}").alias(f"_word{w}") for w in range(n_words)])
    return met.select(F.col(f"`{index}`"), "_home", F.array(*[f"_word{w}" for w in range(n_words)]).alias("present"))


def is_present(number: int) -> Column:
    """Whether a table is among those of ``present``."""
    return F.get("present", F.lit(number // _WORD)).bitwiseAND(F.lit(1 << number % _WORD).cast("bigint")) != 0


def outer_join(tables: Sequence[DataFrame], index: str, unique: bool = False) -> DataFrame:
    """Full outer join of tables on the index, without duplicate rows.

    Every table is completed with one all-NULL row per index value that only the
    others hold. After that an inner join gives the full outer join, and an inner
    join keeps its partitioning over the whole chain (each table is shuffled once)
    and can be split on either side by adaptive execution when a value is hot,
    which a full outer join cannot. ``unique`` says that no table repeats a row,
    which saves the removal of duplicates.
    """
    check_same_index(tables, index)
    return _chain(list(tables) if unique else [t.distinct() for t in tables], index)


def _chain(tables: Sequence[DataFrame], index: str) -> DataFrame:
    """The full outer join of tables without duplicate rows, one after another."""
    if len(tables) == 1:
        return tables[0]
    presence = index_presence(tables, index)
    completed = [
        _with_home(table, index, i).unionByName(
            presence.filter(~is_present(i)).drop("present"),
            allowMissingColumns=True,
        )
        for i, table in enumerate(tables)
    ]
    return reduce(lambda a, b: join_back(a, b, [index, "_home"]), completed).drop("_home")


def repeating_tables(tables: Sequence[DataFrame], index: str) -> list[int]:
    """Numbers of the tables in which an index value stands in more than one row.

    One job that reads the indices alone and counts them before the shuffle; at most
    one number per table reaches the driver.
    """
    keys = _union([t.select(F.col(f"`{index}`"), F.lit(i).alias("_table")) for i, t in enumerate(tables)])
    counted = keys.groupBy(f"`{index}`", "_table").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["_table"] for r in counted.filter("n > 1").select("_table").distinct().collect())


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    """The rows of frames of one schema; halves are joined, as each step analyses what is below it."""
    if len(frames) == 1:
        return frames[0]
    middle = len(frames) // 2
    return _union(frames[:middle]).union(_union(frames[middle:]))


def _side_by_side(tables: Sequence[DataFrame], index: str) -> DataFrame:
    """Full outer join of tables that have each index value once, in one shuffle.

    Rows of all tables become one kind of row: the index, the number of the table and
    an array of its cells for each type of cell. A group holds at most one row per table,
    which is one row of the result, so no group is larger than that. A value that a table
    repeats after all is an error of the job.
    """
    kinds = list(dict.fromkeys(f.dataType for t in tables for f in t.schema if f.name != index))
    tagged, places = [], []
    for i, table in enumerate(tables):
        own: list[list[str]] = [[] for _ in kinds]
        for f in table.schema:
            if f.name != index:
                at = kinds.index(f.dataType)
                places.append((f.name, i, at, len(own[at])))
                own[at].append(f.name)
        cells = [
            F.array(*[F.col(f"`{c}`") for c in names]).cast(ArrayType(kind)).alias(f"_cells{k}")
            for k, (kind, names) in enumerate(zip(kinds, own))
        ]
        keyed = _with_home(table, index, i)
        tagged.append(keyed.select(F.col(f"`{index}`"), "_home", F.lit(i).alias("_table"), F.struct(*cells).alias("_row")))
    rows = F.map_from_entries(F.collect_list(F.struct("_table", "_row")))
    grouped = _union(tagged).groupBy(f"`{index}`", "_home").agg(rows.alias("_by"))
    # a table's row is looked up once, then its cells are read by place; read twice, the
    # map is not built again for every table
    numbers = F.sequence(F.lit(0), F.lit(len(tables) - 1))
    looked_up = F.when(F.col("_by").isNotNull(), F.transform(numbers, lambda i: F.col("_by")[i]))
    placed = grouped.select(F.col(f"`{index}`"), looked_up.alias("_rows"))
    return placed.select(
        F.col(f"`{index}`"),
        *[F.get(F.get("_rows", F.lit(i))[f"_cells{at}"], F.lit(k)).alias(name) for name, i, at, k in places],
    )


def outer_join_many(tables: Sequence[DataFrame], index: str, unique: bool = False) -> DataFrame:
    """The rows and columns of ``outer_join``, for many tables.

    Tables that have each index value once are put side by side in one shuffle, however
    many there are. Only those that repeat a value, which multiplies rows, are joined one by
    one, so that a hot value can be split; which ones these are takes one job over the
    indices. ``unique`` says that no table repeats a value and saves that job. Select
    the columns before: all columns of the tables take part in the shuffle.
    """
    check_same_index(tables, index)
    repeating = [] if unique else repeating_tables(tables, index)
    single = [t for i, t in enumerate(tables) if i not in set(repeating)]
    parts = [tables[i].distinct() for i in repeating]
    if single:
        parts.insert(0, _side_by_side(single, index) if len(single) > 1 else single[0])
    order = [index, *[c for t in tables for c in t.columns if c != index]]
    return _chain(parts, index).select(*[F.col(f"`{c}`") for c in order])


def natural_join(parts: Sequence[DataFrame], index: str) -> DataFrame:
    """Inner join of the vertical parts of one table on their index."""
    check_same_index(parts, index)
    return reduce(lambda a, b: a.join(b, index, "inner"), parts)


def to_long(df: DataFrame, index: str) -> DataFrame:
    """(feature, name, value) rows of a wide table, without missing values."""
    names = [c for c in df.columns if c != index]
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("double").alias("value"))
            for c in names
        ]
    )
    return (
        df.select(F.col(f"`{index}`").alias("feature"), F.explode(pairs).alias("cell"))
        .select("feature", "cell.name", "cell.value")
        .filter(F.col("value").isNotNull())
    )


def pivot_long(
    df: DataFrame,
    feature: str,
    name: str,
    value: str,
    columns: Sequence[str],
    repeated: bool = False,
) -> DataFrame:
    """Wide table from long rows, one column per listed name.

    With a unique index there is one row per feature. Long rows meet by feature before they
    become wide ones: a task then holds the wide rows of its own features only, where
    combining before the shuffle would hold nearly all features in every task. A second
    value in a cell is an error of the job, never lost. With ``repeated`` a
    feature has as many rows as its fullest column has values: the first values of all
    columns stand in its first row, and so on, in ascending order.
    """
    keys = [F.col(f"`{feature}`")]
    if repeated:
        order = F.col(f"`{value}`").asc_nulls_last()
        df = with_position(df.select(feature, name, value), [order], [feature, name], "_nth")
        keys.append(F.col("_nth"))
    cell = F.max(F.col(f"`{value}`"))
    again = F.raise_error(F.lit("an index value is repeated in a column; pivot with repeated=True"))
    if not repeated:
        cell = F.when(F.count(F.col(f"`{value}`")) > 1, again.cast(df.schema[value].dataType)).otherwise(cell)
        df = df.repartition(*keys)
    wide = (
        df.groupBy(*keys)
        .pivot(f"`{name}`" if not name.isidentifier() else name, list(columns))
        .agg(cell)
    )
    return wide.drop("_nth")


def column_names(df: DataFrame, name: str) -> list[str]:
    """Distinct column names of long rows, in natural order; they become a schema."""
    found = df.select(F.col(f"`{name}`").alias("n")).distinct()
    return [row["n"] for row in found.orderBy(*natural_order(["n"])).collect()]


# Rules of joinability, over file descriptors.
_ATTRIBUTES = ("datatype", "technology", "joinable", "type", "index_name")


def check_joinable(files: DataFrame) -> None:
    """Raise when the described files cannot be joined into one table."""
    summary: list = [F.count(F.lit(1)).alias("n")]
    for c in _ATTRIBUTES:
        text = F.col(c).cast("string")
        summary += [
            F.min(text).alias(f"{c}_min"),
            F.max(text).alias(f"{c}_max"),
            F.count(text).alias(f"{c}_n"),
        ]
    row = files.agg(*summary).first()

    def several(c: str) -> bool:
        mixed = 0 < row[f"{c}_n"] < row["n"]  # a missing value counts as a value
        return mixed or row[f"{c}_min"] != row[f"{c}_max"]

    def always(c: str, value: str) -> bool:
        return row[f"{c}_n"] == row["n"] and row[f"{c}_min"] == row[f"{c}_max"] == value

    if row["n"] <= 1:
        return
    if several("datatype"):
        raise DataError("the files hold several datatypes; select one of them")
    if several("technology"):
        raise DataError("the files come from several technologies; select one of them")
    if not always("joinable", "true"):
        raise DataError("files of this datatype are read one at a time; select a single file")
    if not always("type", "table"):
        raise DataError("only tables can be joined; select table files")
    if several("index_name"):
        raise DataError("the tables are indexed by different things; select files of one kind")
