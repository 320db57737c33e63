"""Benchmark passages in training text, by a positional inverted index.

The index holds a row (document row, position, term) for each occurrence of a benchmark
term in the training text, in segments by document: building it shuffles nothing. It is
stored once and everything else reads it.

A phrase is searched from its rarest terms: each occurrence of the rarest one, shifted
back by the term's offset in the phrase, is a possible start. These starts are
intersected with the shifted occurrences of the next rarest terms; what is left is
verified against all terms. Windows of one item that lie side by side share their rarest
terms, so starts are kept per item (as the diagonal: position less position in the item),
and windows are read off the verified diagonal.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylens.llm.tables import fresh, release, stored, words

WINDOW = 10
RAREST = 3  # terms of a window whose lists are intersected before verification


def items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_row, item, n, at, word): the words of all items, stored; items without words give none."""
    tokens = benchmark.select(
        F.monotonically_increasing_id().alias("item_row"),
        F.col(f"`{id_col}`").cast("string").alias("item"),
        words(F.col(f"`{text_col}`")).alias("ws"),
    )
    listed = tokens.select(
        "item_row", "item", F.size("ws").alias("n"), F.posexplode("ws").alias("at", "word")
    )
    return stored(listed, "items")


def vocabulary(item_words: DataFrame) -> DataFrame:
    """(term, word): the distinct words of the items with numbers, stored."""
    distinct = item_words.select("word").distinct()
    return stored(distinct.select(F.monotonically_increasing_id().alias("term"), "word"), "terms")


def index(
    docs: DataFrame,
    terms: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_col: str | None = None,
) -> DataFrame:
    """The stored index: (row, id, n_words, pos, term), and a row with term -1 per document.

    NULL and empty texts have no words. Rows repeating an id are documents of their own.
    """
    row = F.col(f"`{row_col}`") if row_col else F.monotonically_increasing_id()
    tokens = docs.select(
        row.alias("row"),
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        words(F.col(f"`{text_col}`")).alias("ws"),
    )
    # the empty string is no word: it stands for the document itself
    listed = tokens.select(
        "row",
        "id",
        F.size("ws").alias("n_words"),
        F.posexplode(F.concat(F.array(F.lit("")), "ws")).alias("pos", "word"),
    )
    marked = terms.union(
        terms.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("term"), F.lit("").alias("word"))
    )
    found = listed.join(stored(marked, "vocabulary"), "word")
    return stored(found.select("row", "id", "n_words", (F.col("pos") - 1).alias("pos"), "term"), "index")


def _windows(item_terms: DataFrame, size: int) -> DataFrame:
    """(item_row, first, length): the windows of all items."""
    lengths = item_terms.groupBy("item_row").agg(F.max("n").alias("n"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0)))
    return lengths.select(
        "item_row", F.least("n", F.lit(size)).alias("length"), F.explode(starts).alias("first")
    )


def anchors(postings: DataFrame, item_terms: DataFrame, size: int, rarest: int) -> DataFrame:
    """(item_row, first, length, at, term, rank): the rarest terms of each window, stored.

    Frequencies are those of the whole index. A window without some term in the index
    cannot occur and has no rows.
    """
    seen = postings.where("term >= 0").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = item_terms.join(stored(seen, "frequencies"), "term", "left")
    spans = _windows(item_terms, size)
    inside = weighed.join(spans, "item_row").where("at >= first AND at < first + length")
    # at most ``size`` rows per window
    window = Window.partitionBy("item_row", "first")
    ranked = inside.select(
        "item_row", "n", "first", "length", "at", "term",
        F.count("df").over(window).alias("present"),
        F.row_number().over(window.orderBy(F.col("df").asc_nulls_first(), "at")).alias("rank"),
    )
    kept = ranked.where("present = length").where(F.col("rank") <= rarest).drop("present")
    return stored(kept, "anchors")


def diagonals(postings: DataFrame, chosen: DataFrame, rarest: int) -> DataFrame:
    """(row, item_row, diagonal) where the rarest terms of some window all stand, stored."""
    # the rarest term of each window: its occurrences are the possible starts
    lead = chosen.where("rank = 1").select("item_row", "at", "term").distinct()
    starts = postings.join(lead, "term").select(
        "row", "item_row", "at", (F.col("pos") - F.col("at")).alias("diagonal")
    )
    # a diagonal is negative where a document begins inside an item
    starts = stored(starts, "starts")
    # the others' lists, only of documents with a start, shifted the same way
    others = chosen.where("rank > 1").select("item_row", F.col("at").alias("next"), "term").distinct()
    where = starts.select("row").distinct()
    near = postings.join(others.select("term").distinct(), "term", "left_semi")
    near = near.join(where, "row", "left_semi")
    shifted = near.join(others, "term").select(
        "row", "item_row", "next", (F.col("pos") - F.col("next")).alias("diagonal")
    )
    wanted = starts.select("row", "item_row", "diagonal").distinct()
    met = stored(
        shifted.join(wanted, ["row", "item_row", "diagonal"], "left_semi"), "met"
    )
    # a window holds if its lead and its other rarest terms stand on the diagonal
    every = met.withColumnRenamed("next", "at").unionByName(
        starts.select("row", "item_row", "at", "diagonal")
    ).distinct()
    needs = chosen.select("item_row", "first", "length", "at").withColumn(
        "need", F.least("length", F.lit(rarest))
    )
    held = (
        every.join(needs, ["item_row", "at"])
        .groupBy("row", "item_row", "diagonal", "first", "need")
        .agg(F.count(F.lit(1)).alias("have"))
        .where("have = need")
    )
    held = stored(held.select("row", "item_row", "diagonal").distinct(), "diagonals")
    release(starts, met)
    return held


def phrases(
    postings: DataFrame, item_words: DataFrame, terms: DataFrame, size: int = WINDOW, rarest: int = RAREST
) -> DataFrame:
    """(row, item_row, item, start, end): maximal stretches of item windows found, stored.

    Every window of ``size`` consecutive words of an item (an item of fewer words is one
    window) that stands in a document lies in one of the stretches, and all of a
    stretch's words lie in such windows. Positions are in the document, end exclusive.
    """
    item_terms = stored(item_words.join(terms, "word").drop("word"), "item-terms")
    chosen = anchors(postings, item_terms, size, rarest)
    found = diagonals(postings, chosen, rarest)
    # verification: all words of the item against the document, along the diagonal
    expected = found.join(item_terms, "item_row").select(
        "row", (F.col("diagonal") + F.col("at")).alias("pos"), "term", "item_row", "item", "n", "at", "diagonal"
    )
    inside = postings.join(found.select("row").distinct(), "row", "left_semi").select("row", "pos", "term")
    agree = inside.join(expected, ["row", "pos", "term"])
    # consecutive positions share the difference to their rank; at most n rows a diagonal
    line = Window.partitionBy("row", "item_row", "diagonal").orderBy("at")
    runs = agree.withColumn("run", F.col("at") - F.row_number().over(line))
    spans = runs.groupBy("row", "item_row", "item", "n", "diagonal", "run").agg(
        F.min("pos").alias("start"), (F.max("pos") + 1).alias("end")
    )
    long_enough = F.col("end") - F.col("start") >= F.least(F.lit(size), F.col("n"))
    return stored(spans.where(long_enough).select("row", "item_row", "item", "start", "end"), "phrases")


def proximity(
    postings: DataFrame, item_words: DataFrame, terms: DataFrame, slop: int = 3, size: int = WINDOW
) -> DataFrame:
    """(row, item_row, first, near): windows all of whose words stand close together.

    Close means: shifted by their offsets, all lie within ``slop`` of where the rarest
    one puts the window; order does not matter. ``near`` is the smallest such start.
    Occurrences are matched by blocks of ``slop + 1`` starts, looking at both neighbours.
    """
    item_terms = stored(item_words.join(terms, "word").drop("word"), "item-terms")
    chosen = anchors(postings, item_terms, size, size)
    block = slop + 1
    lists = postings.join(chosen, "term").select(
        "row", "item_row", "first", "length", "at", "rank",
        (F.col("pos") - F.col("at") + F.col("first")).alias("start"),
    )
    lead = lists.where("rank = 1").select("row", "item_row", "first", F.col("start").alias("near"))
    reach = lead.withColumn("cell", F.explode(F.array(*[F.floor(F.col("near") / block) + d for d in (-1, 0, 1)])))
    others = lists.withColumn("cell", F.floor(F.col("start") / block))
    met = reach.join(others, ["row", "item_row", "first", "cell"]).where(
        F.abs(F.col("start") - F.col("near")) <= slop
    )
    whole = met.groupBy("row", "item_row", "first", "length", "near").agg(
        F.count_distinct("at").alias("have")
    )
    return whole.where("have = length").groupBy("row", "item_row", "first").agg(F.min("near").alias("near"))


def _covered(found: DataFrame) -> DataFrame:
    """(row, n_hit): distinct words of a document inside stretches."""
    # stretches of one document in order; the words past the furthest end so far are new
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    distinct = found.select("row", "start", "end").distinct()
    reached = distinct.withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
    new = F.greatest(F.col("end") - F.greatest("start", "reached"), F.lit(0))
    return reached.groupBy("row").agg(F.sum(new).alias("n_hit"))


def report(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    rarest: int = RAREST,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    row_col: str | None = None,
) -> DataFrame:
    """For each document: row, id, n_words, n_hit, n_items, items (sorted, joined by commas).

    NULL and empty texts have no words and no hits; items without words match nothing.
    Items repeating an id count once; a NULL item id is not listed, its words are hit all
    the same. No documents give no rows, no items no hits. Other columns are not looked at.
    """
    item_words = items(benchmark, item_col, item_text)
    terms = vocabulary(item_words)
    postings = index(docs, terms, id_col, text_col, row_col)
    found = phrases(postings, item_words, terms, size, rarest)
    listed = found.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    hits = stored(_covered(found).join(listed, "row"), "hits").withColumnRenamed("row", "hit_row")
    every = stored(postings.where("term = -1").select("row", "id", "n_words"), "lengths")
    release(postings)
    none = F.array().cast("array<string>")
    return every.join(hits, F.col("row") == F.col("hit_row"), "left").select(
        "row",
        "id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(F.coalesce("ids", none)).cast("bigint").alias("n_items"),
        F.array_join(F.coalesce("ids", none), ",").alias("items"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents without a word inside a benchmark window, with their columns."""
    row = fresh(docs, "_row")
    tagged = stored(docs.withColumn(row, F.monotonically_increasing_id()), "tagged")
    found = report(tagged, benchmark, size, row_col=row)
    hit = stored(found.where("n_hit > 0").select(F.col("row").alias(row)), "hit")
    return tagged.join(hit, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(ids: Column) -> Column:
    """The SHA-256 of a joined list, in lowercase hex."""
    return F.sha2(ids.cast("binary"), 256)
