"""Licences in text by diagonal voting.

All rolling word k-grams of a text are joined with the k-grams of the templates. Each
shared k-gram votes for the diagonal it lies on, the position in the text less the
position in the template. A phrase that stands in a text word for word fills one diagonal;
a template with words added or left out spreads over neighbouring ones, which are merged
if they follow each other closely. A merged stretch counts if it covers enough of the
template's k-grams. Votes are cast by hash and verified by the words themselves.

DataFrame operations only. Templates are few and fixed, so they are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assaylens.llm.tables import stored, words

K = 3
_GRAMS = "array<struct<pos: int, hash: bigint, words: array<string>>>"
COVERAGE = 0.7  # of a template's k-grams
GAP = 6  # words between diagonals that are merged, and how far apart these may be


@dataclass(frozen=True)
class Template:
    """A licence text. A phrase counts word for word only; a notice may be altered."""

    label: str
    text: str
    phrase: bool = False


# fixed values: phrases that name a licence
PHRASES = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)

# fixed values: public licence notices
NOTICES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    Template(
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies",
    ),
    Template("gpl-3", "GNU General Public License, version 3", True),
    Template("gpl-2", "GNU General Public License, version 2", True),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation",
    ),
    Template(
        "lgpl",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation",
    ),
    Template(
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    Template("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc-by-nc", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    Template("public-domain", "This is free and unencumbered software released into the public domain"),
    Template("all-rights-reserved", "all rights reserved", True),
)


def _grams(tokens: str, k: int) -> Column:
    """The k-grams of an array of words: their hashes, in order."""
    ws = F.col(tokens)
    starts = F.when(F.size(ws) >= k, F.sequence(F.lit(0), F.size(ws) - k)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(ws, i + d) for d in range(k)]))


def template_grams(spark: SparkSession, templates: Sequence[Template], k: int = K) -> DataFrame:
    """(template, label, phrase, grams, at, gram_hash, gram): all k-grams of all templates."""
    listed = [(n, t.label, t.phrase, t.text) for n, t in enumerate(templates)]
    frame = spark.createDataFrame(listed, "template int, label string, phrase boolean, text string")
    tokens = frame.withColumn("t_ws", words(F.col("text"))).withColumn("hashes", _grams("t_ws", k))
    return tokens.select(
        "template", "label", "phrase", "t_ws", F.size("hashes").alias("grams"),
        F.posexplode("hashes").alias("at", "gram_hash"),
    ).withColumn("gram", F.slice("t_ws", F.col("at") + 1, k)).drop("t_ws")


def votes(
    docs: DataFrame, templates: Sequence[Template], k: int = K, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Stored rows (row, id, n_words, pos, template, label, phrase, grams, at), one per vote.

    A row with template -1 stands for the document itself, so one pass gives both.
    """
    spark = docs.sparkSession
    tokens = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        words(F.col(f"`{text_col}`")).alias("ws"),
    )
    known = template_grams(spark, templates, k)
    hashes = [r.gram_hash for r in known.select("gram_hash").distinct().collect()]  # as many as templates have
    # only grams that may stand in a template become rows, each with its own words
    at = F.transform(_grams("ws", k), lambda h, i: F.struct(i.alias("pos"), h.alias("hash")))
    found = F.transform(
        F.filter(at, lambda g: g.getField("hash").isin(hashes)),
        lambda g: F.struct(
            g.getField("pos").alias("pos"),
            g.getField("hash").alias("hash"),
            F.slice("ws", g.getField("pos") + 1, k).alias("words"),
        ),
    )
    # the first entry is the document's own
    own = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(0).cast("bigint").alias("hash"), F.lit(None).alias("words")))
    listed = tokens.select(
        "row", "id", F.size("ws").alias("n_words"), F.explode(F.concat(own.cast(_GRAMS), found.cast(_GRAMS))).alias("g")
    ).select("row", "id", "n_words", "g.*")
    same = (F.col("hash") == F.col("gram_hash")) & (F.col("words") == F.col("gram"))
    joined = listed.join(F.broadcast(known), (F.col("pos") >= 0) & same, "left")
    joined = joined.where((F.col("pos") < 0) | F.col("template").isNotNull())
    joined = joined.withColumn("template", F.coalesce("template", F.lit(-1)))
    return stored(
        joined.select(
            "row", "id", "n_words", "pos", "template", "label", "phrase", "grams", "at",
        ),
        "votes",
    )


def spans(cast: DataFrame, k: int = K, coverage: float = COVERAGE, gap: int = GAP) -> DataFrame:
    """(row, template, label, start, end, covered): verified stretches, end exclusive, in words."""
    diagonal = F.col("pos") - F.col("at")
    lines = (
        cast.where("template >= 0")
        .withColumn("diagonal", diagonal)
        .groupBy("row", "template", "label", "phrase", "grams", "diagonal")
        .agg(
            F.min("pos").alias("start"),
            (F.max("pos") + k).alias("end"),
            F.collect_set("at").alias("ats"),
        )
    )
    whole = lines.where(F.col("phrase") & (F.size("ats") == F.col("grams"))).select(
        "row", "template", "label", "start", "end", F.lit(1.0).alias("covered")
    )
    # one document's votes for one template, in order of place
    order = Window.partitionBy("row", "template").orderBy("start", "diagonal")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    apart = (
        (F.abs(F.col("diagonal") - F.lag("diagonal").over(order)) > gap)
        | (F.col("start") - F.max("end").over(before) > gap)
    )
    parted = (
        lines.where(~F.col("phrase"))
        .withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("stretch", F.sum("new").over(order))
    )
    merged = parted.groupBy("row", "template", "label", "grams", "stretch").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        # at most the template's k-grams per diagonal, and the diagonals are close
        F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("n"),
    )
    covered = F.col("n") / F.col("grams")
    altered = merged.select("row", "template", "label", "start", "end", covered.alias("covered"))
    return whole.union(altered.where(F.col("covered") >= coverage))


def scan(
    docs: DataFrame,
    phrases: Sequence[Template] = PHRASES,
    notices: Sequence[Template] = NOTICES,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = K,
) -> DataFrame:
    """For each document: row, id, n_words, base phrases found, labels and a score.

    n_base counts the places of ``phrases``, first_word and last_word are their smallest
    and largest starts (NULL without any), base_labels their labels; labels has those of
    the notices as well; score is the best coverage of any template, 0 without. NULL and
    empty texts have no words and no labels; rows repeating an id are documents of their
    own; no documents give no rows. Other columns are not looked at.
    """
    cast = votes(docs, [*phrases, *notices], k, id_col, text_col)
    found = spans(cast, k)
    base = F.col("template") < len(phrases)
    per_row = found.groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base"),
        F.array_sort(F.collect_set("label")).alias("all"),
        F.max("covered").alias("score"),
    )
    per_row = stored(per_row, "licences").withColumnRenamed("row", "found_row")
    every = cast.where("template = -1").select("row", "id", "n_words")
    joined = every.join(per_row, F.col("row") == F.col("found_row"), "left")
    return joined.select(
        "row",
        "id",
        F.col("n_words").cast("bigint").alias("n_words"),
        F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"),
        F.col("first_word").cast("bigint").alias("first_word"),
        F.col("last_word").cast("bigint").alias("last_word"),
        F.coalesce(F.array_join("base", ","), F.lit("")).alias("base_labels"),
        F.coalesce(F.array_join("all", ","), F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
