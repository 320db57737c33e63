"""URL filter: rules first, then gradient-boosted trees on lexical features.

A rule names a host and the beginning of a path; it fits the host, all its subdomains and
all paths that begin so. Of several that fit the longest decides. URLs that no rule fits
are judged by boosted trees over features of the text alone: lengths, depth, share of
digits, entropy, counts of parameters, hyphens and dots, how the suffixes of the host
(its last one, two and three labels) fared among the labelled URLs, and those of the
words and word pieces of the host that tell the labels apart best.

What the trees learn from says nothing of a row's own label: the shares of its suffixes
are counted over other hosts only, so a suffix of one host has the prior and no weight,
as one that was never seen has when a new URL is judged.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import HashingTF, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylens.llm.tables import ascii_lower, fresh, stored

TRAIN = 20_000  # labelled URLs that the trees are grown from at most
PRIOR = 20.0  # labelled URLs that a suffix's own statistics must outweigh
FOLDS = 10  # groups of hosts; the shares that a URL is learned with come from the other groups
BUCKETS = 1 << 14  # hashed words and word pieces of hosts
CHOSEN = 64  # those of them, by their chi-squared statistics, that the trees look at
PIECE = 4  # letters of a word piece


@dataclass(frozen=True)
class Rule:
    verdict: str  # block or allow
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)

# fixed values: words in host names that label a URL as unwanted
UNWANTED = ("casino", "bets", "poker", "pills", "pharma", "viagra", "adult", "porn", "xxx", "spam", "ads-", "-ads")


def host(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """From after the host up to ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(rule: Rule, host_col: Column, path_col: Column) -> Column:
    """Whether a rule fits; an empty rule path or / fits any path that begins with it."""
    inside = (host_col == rule.host) | host_col.endswith(f".{rule.host}")
    return inside & path_col.startswith(rule.path)


def decide(host_col: Column, path_col: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as (rule, verdict); NULL if none fits. First of equals wins."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name), reverse=True)[::-1]:
        found = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits(rule, host_col, path_col), found).otherwise(chosen)
    return chosen


def _count(text: Column, of: str) -> Column:
    """How many characters of a class a text has."""
    return F.length(F.regexp_replace(text, f"[^{of}]", ""))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    characters = F.split(text, "")
    shares = F.transform(
        F.array_distinct(characters), lambda c: F.size(F.array_remove(characters, c)) / F.size(characters)
    )
    bits = F.aggregate(
        shares, F.lit(0.0), lambda total, rest: total - F.when(rest < 1, (1 - rest) * F.log2(1 - rest)).otherwise(0.0)
    )
    return F.when(n > 0, bits).otherwise(0.0)


def lexical(url: Column) -> dict[str, Column]:
    """The features of the text of a URL."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    h, p = host(url), path(url)
    n = F.length(text)
    return {
        "url_length": n,
        "host_length": F.length(h),
        "path_length": F.length(p),
        "depth": F.size(F.filter(F.split(p, "/"), lambda part: part != "")),
        "labels": F.size(F.filter(F.split(h, r"\."), lambda part: part != "")),
        "digit_ratio": _count(text, "0-9") / F.greatest(n, F.lit(1)),
        "hyphens": _count(h, "\\-"),
        "entropy": _entropy(h),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))),
        "fragment": F.instr(text, "#").cast("boolean").cast("int"),
        "secure": text.startswith("https").cast("int"),
    }


SUFFIXES = (1, 2, 3)


def suffix(host_col: Column, n: int) -> Column:
    """The last n labels of a host."""
    return F.substring_index(host_col, ".", -n)


def spellings(host_col: Column) -> Column:
    """The words of a host that have three letters or more, and their pieces of four letters."""
    found = F.filter(F.split(host_col, "[^a-z]+"), lambda w: F.length(w) >= 3)
    long = F.filter(found, lambda w: F.length(w) > PIECE)
    cut = F.transform(
        long, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - PIECE + 1), lambda k: F.substr(w, k, F.lit(PIECE)))
    )
    # a piece is told from a word by its mark
    return F.array_distinct(F.concat(found, F.transform(F.flatten(cut), lambda c: F.concat(F.lit("~"), c))))


@dataclass
class Model:
    """Trees, the chosen spellings, and the share of blocked URLs per suffix as a stored table."""

    trees: object
    selector: object
    suffixes: DataFrame
    prior: float


def _with_features(urls: DataFrame, shares: DataFrame, prior: float, url_col: str, names: dict[str, str]) -> DataFrame:
    """Add the features under the given names; shares per fold go to the URLs of that fold."""
    out = urls
    u = F.col(f"`{url_col}`")
    by_fold = "fold" in shares.columns
    for name, column in lexical(u).items():
        out = out.withColumn(names[name], column.cast("double"))
    if by_fold:
        out = out.withColumn(names["fold"], _fold(host(u)))
    for n in SUFFIXES:
        own = shares.where(F.col("labels") == n).select(
            F.col("suffix").alias(names[f"key{n}"]),
            *([F.col("fold").alias(names["fold"])] if by_fold else []),
            F.col("share").alias(names[f"share{n}"]),
            F.col("weight").alias(names[f"weight{n}"]),
        )
        keys = [names[f"key{n}"], *([names["fold"]] if by_fold else [])]
        out = out.withColumn(names[f"key{n}"], suffix(host(u), n)).join(own, keys, "left")
        out = out.fillna({names[f"share{n}"]: prior, names[f"weight{n}"]: 0.0})
    out = out.withColumn(names["spellings"], spellings(host(u)))
    hashing = HashingTF(numFeatures=BUCKETS, binary=True, inputCol=names["spellings"], outputCol=names["hashed"])
    return hashing.transform(out)


def _names(df: DataFrame) -> dict[str, str]:
    wanted = [*lexical(F.lit("")), *[f"{k}{n}" for n in SUFFIXES for k in ("key", "share", "weight")]]
    return {w: fresh(df, f"_{w}") for w in [*wanted, "fold", "spellings", "hashed", "chosen"]}


def _inputs(names: dict[str, str]) -> list[str]:
    numbers = [*lexical(F.lit("")), *[f"{k}{n}" for n in SUFFIXES for k in ("share", "weight")]]
    return [names[w] for w in [*numbers, "chosen"]]


def _fold(host_col: Column) -> Column:
    return F.pmod(F.xxhash64(host_col), F.lit(FOLDS))


def _share(n: Column, bad: Column, prior: float) -> list[Column]:
    """The smoothed share of blocked URLs among some, and how much there is behind it."""
    return [
        ((bad + PRIOR * prior) / (n + PRIOR)).alias("share"),
        F.log1p(n.cast("double")).alias("weight"),
    ]


def fit(labelled: DataFrame, train: int = TRAIN, rounds: int = 20, depth: int = 4) -> Model | None:
    """Grow trees from (url, blocked); None if there is but one kind of label.

    Suffix statistics come from all labelled URLs. The trees are grown from at most
    ``train`` of them, those with the smallest hash of the URL, each with the statistics of
    the other folds of hosts. NULL labels are not used.
    """
    labelled = labelled.where(F.col("blocked").isNotNull()).select("url", F.col("blocked").cast("double").alias("blocked"))
    h = host(F.col("url"))
    counted = labelled.withColumn("parts", F.array(*[F.struct(F.lit(n).alias("labels"), suffix(h, n).alias("suffix")) for n in SUFFIXES]))
    totals = labelled.agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("bad")).head()
    if not totals["n"] or totals["bad"] in (0.0, float(totals["n"])):
        return None
    prior = totals["bad"] / totals["n"]
    counts = stored(
        counted.select("blocked", _fold(h).alias("fold"), F.explode("parts").alias("part"))
        .groupBy("part.labels", "part.suffix", "fold")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("bad")),
        "suffix-counts",
    )
    whole = counts.groupBy("labels", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = stored(whole.select("labels", "suffix", *_share(F.col("n"), F.col("bad"), prior)), "suffixes")
    # at most a row per fold in each window
    every = Window.partitionBy("labels", "suffix")
    others = counts.select(
        "labels", "suffix", "fold",
        *_share(F.sum("n").over(every) - F.col("n"), F.sum("bad").over(every) - F.col("bad"), prior),
    )
    sample = stored(labelled.orderBy(F.xxhash64("url"), "url", "blocked").limit(train), "urls")
    names = _names(sample)
    prepared = _with_features(sample, others, prior, "url", names)
    kept = stored(prepared.select("blocked", *[F.col(c) for c in _inputs(names)[:-1]], names["hashed"]), "features")
    selector = UnivariateFeatureSelector(
        featuresCol=names["hashed"], outputCol=names["chosen"], labelCol="blocked", selectionMode="numTopFeatures"
    )
    selector = selector.setFeatureType("categorical").setLabelType("categorical").setSelectionThreshold(CHOSEN).fit(kept)
    vector = VectorAssembler(inputCols=_inputs(names), outputCol="_features")
    ready = vector.transform(selector.transform(kept)).select("blocked", "_features")
    grown = GBTClassifier(
        featuresCol="_features", labelCol="blocked", maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=7
    ).fit(ready)
    return Model(grown, selector, suffixes, prior)


def judge(
    pages: DataFrame,
    model: Model | None,
    rules: Sequence[Rule] = RULES,
    url_col: str = "url",
) -> DataFrame:
    """The rows with host, path, rule, verdict and, where no rule fits, the trees' probability.

    The added columns are a struct ``url_verdict``, so no column of the input is hidden. A
    NULL URL and one without :// have an empty host and path, fit no rule and are allowed,
    as are all URLs that no rule fits if there is no model. Rows are judged each for itself.
    """
    u = F.col(f"`{url_col}`")
    out = fresh(pages, "url_verdict")
    rule, chance = fresh(pages, "_rule"), fresh(pages, "_chance")
    judged = pages.withColumn(rule, decide(host(u), path(u), rules))
    if model is None:
        judged = judged.withColumn(chance, F.lit(0.0))
    else:
        names = _names(judged)
        vector, scored = fresh(judged, "_features"), fresh(judged, "_scored")
        prepared = _with_features(judged, model.suffixes, model.prior, url_col, names)
        selector = model.selector.copy()
        selector.setFeaturesCol(names["hashed"]).setOutputCol(names["chosen"])
        prepared = VectorAssembler(inputCols=_inputs(names), outputCol=vector).transform(selector.transform(prepared))
        trees = model.trees.copy()
        trees.setFeaturesCol(vector).setProbabilityCol(scored)
        trees.setRawPredictionCol(fresh(judged, "_raw")).setPredictionCol(fresh(judged, "_prediction"))
        judged = trees.transform(prepared).withColumn(
            chance, F.when(host(u) == "", 0.0).otherwise(F.get(vector_to_array(scored), F.lit(1)))
        )
    by_trees = F.when(F.col(chance) >= 0.5, "block").otherwise("allow")
    return judged.select(
        *[F.col(f"`{c}`") for c in pages.columns],
        F.struct(
            host(u).alias("host"),
            path(u).alias("path"),
            F.col(f"{rule}.rule").alias("rule"),
            F.coalesce(F.col(f"{rule}.verdict"), by_trees).alias("verdict"),
            F.when(F.col(rule).isNull(), F.col(chance)).alias("chance"),
        ).alias(out),
    )


def labels(pages: DataFrame, rules: Sequence[Rule] = RULES, url_col: str = "url") -> DataFrame:
    """(url, blocked): URLs labelled by unwanted words in the host.

    Those in use that have no such word count as allowed. URLs without a host are not
    labelled, nor are those that a rule fits: the trees never judge them.
    """
    u = F.col(f"`{url_col}`")
    h = host(u)
    unwanted = h.rlike("|".join(re.escape(w) for w in UNWANTED))
    free = (h != "") & decide(h, path(u), rules).isNull()
    return pages.where(free).select(u.alias("url"), unwanted.cast("int").alias("blocked"))
