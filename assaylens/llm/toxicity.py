"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, replaces homoglyphs (accents, full width, Cyrillic and Greek
look-alikes) and, inside words, digits and signs that stand for letters, and leaves
words between single spaces. A term is a whole word (`` word ``) or the beginning of
words (`` stem``). Terms inside an exception phrase do not count. The weighted sum of a
document's terms and the same sum per hundred words give the score through a logistic
curve.

The lexicon is learned from labelled documents. To be a candidate, a word or a beginning
must stand in many different contexts of toxic documents, so the words of a text that was
copied many times are none; it is kept if toxic documents have it far more often than
others, or have it so often (one word in a hundred) as others seldom do. The second way
finds the stems of languages whose harmless words begin alike now and then. Either must
hold in both halves of the documents, where equal texts fall into the same half. The fit
reads at most ``sample`` labelled documents (those with the smallest hash of their id), of
which it looks at the ``CANDIDATES`` terms of most contexts and keeps ``TERMS``; scoring
reads everything.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylens.llm.tables import stored

SAMPLE = 12_000  # labelled documents that a fit reads at most
CANDIDATES = 20_000  # candidate terms at most
TERMS = 2_000  # terms of a lexicon at most
MIN_CONTEXTS = 5
RATE = 0.01  # of its words a document must have of a term to have it often
MIN_STEM, MAX_STEM, MIN_WORD = 4, 10, 3

# fixed values: common insults, for corpora without labels
SEED_TERMS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "worthless", "pathetic", "disgusting")
# fixed values: harmless phrases around words of the lexicon
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "take out the trash", "clown fish", "pond scum", "sore loser")
# fixed values: look-alikes of Latin letters, Cyrillic and Greek
LOOKALIKES = dict(
    pair.split(":")
    for pair in (
        "а:a в:b е:e ё:e к:k м:m н:h о:o р:p с:c т:t у:y х:x і:i ї:i ј:j ѕ:s һ:h "
        "α:a β:b ε:e η:n ι:i κ:k ν:v ο:o ρ:p τ:t υ:u χ:x ω:w"
    ).split()
)
# fixed values: digits and signs for letters, inside words only
SUBSTITUTES = str.maketrans("0134578@$!", "oieastbasi")


def _fold_table() -> dict[int, str]:
    """Accented and full-width letters to plain ones, by their decompositions."""
    table = {ord(k): v for k, v in LOOKALIKES.items()}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B)]:
        base = unicodedata.normalize("NFKD", chr(code))[0].lower()
        if base.isascii() and base.isalnum():
            table[code] = base
    for code in range(0x300, 0x370):
        table[code] = ""
    for code in (0x200B, 0x200C, 0x200D, 0xAD, 0xFEFF):
        table[code] = ""
    return table


_FOLD = _fold_table()
# a whole word with a digit or sign in it; every character is looked at once
_MIXED = re.compile(r"(?<!\S)[^\s0-9@$!]*+[0-9@$!]\S*+")
_OTHER = re.compile(r"[\W\d_]++")
_AROUND = "\"'.,;:?()[]{}<>*#%&-_/|\\"


def _substitute(match: re.Match[str], known: Callable[[str], bool] | None = None) -> str:
    core = match[0].strip(_AROUND).rstrip("!")
    # numbers, addresses and codes are no disguised words
    plain = all(c.isalnum() or c in "@$!" for c in core)
    letters = sum(map(str.isalpha, core))
    if not plain or len(core) > 24:
        return match[0]
    folded = core.translate(SUBSTITUTES)
    if letters * 2 < len(core) and not (letters and known and known(folded)):
        return match[0]
    return folded


def fold(text: str | None, known: Callable[[str], bool] | None = None) -> str:
    """Folded words, each after and before one space; mostly digits only if that makes a known word."""
    text = (text or "").lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    text = _OTHER.sub(" ", _MIXED.sub(lambda m: _substitute(m, known), text))
    return f" {text.strip()} "


@dataclass
class Model:
    """Terms with weights, exception phrases and the curve."""

    terms: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 1.5, 1.5)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": None}

    def automaton(self) -> object:
        if self._automaton is None:
            self._automaton = ahocorasick.Automaton()
            for term, weight in self.terms.items():
                self._automaton.add_word(term, (weight, len(term)))
            for phrase in self.exceptions:
                key = f" {phrase} "
                self._automaton.add_word(key, (0.0, len(key)))
            self._automaton.make_automaton()
        return self._automaton

    def knows(self, word: str) -> bool:
        """Whether a word is in the lexicon, whole or by its beginning."""
        return f" {word} " in self.terms or any(f" {word[:n]}" in self.terms for n in range(1, len(word) + 1))

    def features(self, text: str | None) -> tuple[float, float]:
        """Logs of the weighted sum and of the sum per hundred words."""
        folded = fold(text, self.knows)
        found = list(self.automaton().iter(folded)) if len(self.terms) + len(self.exceptions) else []
        spared = [(end - size + 1, end) for end, (weight, size) in found if not weight]
        total = sum(
            weight
            for end, (weight, size) in found
            if weight and not any(a <= end - size + 1 and end <= b for a, b in spared)
        )
        n_words = max(1, folded.count(" ") - 1)
        return math.log1p(total), math.log1p(100.0 * total / n_words)

    def score(self, text: str | None) -> float:
        x, y = self.features(text)
        a, b, c = self.curve
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, a + b * x + c * y))))


def default_model() -> Model:
    """The seed lexicon, for corpora without labels: two terms, or one in a short text."""
    return Model({f" {t} ": 1.0 for t in SEED_TERMS})


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct (term, context) of toxic texts; a context is the words on either side."""
    for batch in batches:
        seen: dict[str, set[int]] = defaultdict(set)
        for text in batch.column(0):
            ws = fold(text.as_py()).split()
            for before, word, after in zip(["", *ws[:-1]], ws, [*ws[1:], ""], strict=True):
                context = hash_context(before, after)
                for form in _forms(word):
                    seen[form].add(context)
        terms = [t for t, c in seen.items() for _ in c]
        contexts = [c for cs in seen.values() for c in cs]
        yield pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), pa.array(contexts, pa.int64())], names=["term", "context"]
        )


def hash_context(before: str, after: str) -> int:
    """A number for the words on either side that is the same in every process."""
    return xxhash.xxh64_intdigest(f"{before} {after}") >> 1


def _forms(word: str) -> Iterator[str]:
    """The terms that a word has: itself and its beginnings."""
    if len(word) >= MIN_WORD:
        yield f" {word} "
    for n in range(MIN_STEM, min(MAX_STEM, len(word)) + 1):
        yield f" {word[:n]}"


def _document_terms(candidates: set[str]):
    """How many documents have each candidate, and have it often, by label and half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has: Counter[tuple[str, int, int]] = Counter()
            often: Counter[tuple[str, int, int]] = Counter()
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ws = Counter(fold(text.as_py()).split())
                half = xxhash.xxh64_intdigest(text.as_py() or "") % 2
                own: Counter[str] = Counter()
                for w, n in ws.items():
                    for form in _forms(w):
                        if form in candidates:
                            own[form] += n
                least = RATE * ws.total()
                has.update((t, toxic, half) for t in own)
                often.update((t, toxic, half) for t, n in own.items() if n >= least)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([t for t, _, _ in has], pa.string()),
                    pa.array([y for _, y, _ in has], pa.int32()),
                    pa.array([h for _, _, h in has], pa.int32()),
                    pa.array(list(has.values()), pa.int64()),
                    pa.array([often[k] for k in has], pa.int64()),
                ],
                names=["term", "toxic", "half", "n", "often"],
            )

    return run


def _odds(t: float, o: float, toxic: int, other: int) -> float:
    return math.log((t + 0.5) / (toxic + 1)) - math.log((o + 0.5) / (other + 1))


def choose_terms(stats: dict[str, np.ndarray], contexts: dict[str, int], toxic: int, other: int) -> dict[str, float]:
    """Terms with weights from context counts and document counts.

    The counts of a term are indexed by whether documents have it (0) or have it often
    (1), by half, and by label (0 toxic, 1 other).
    """
    kept: dict[str, float] = {}
    prior = toxic / max(1, toxic + other)
    # beyond what the luckiest of so many unrelated terms would show
    least = 2 * (math.log(max(1, len(stats))) + 3)
    for term, counts in stats.items():
        for halves, pure in zip(counts, (0.8, 0.6), strict=True):
            t, o = halves.sum(axis=0)
            support = min(t, contexts.get(term, 0))
            if support < MIN_CONTEXTS or not 0 < prior < 1:
                continue
            odds = _odds(t, o, toxic, other)
            # surprise of that many toxic documents, were the term unrelated to the label
            share = t / (t + o)
            surprise = 2 * support * math.log(share / prior) if share > prior else 0.0
            both = all(a and a / (a + b) >= 0.5 for a, b in halves)
            if odds > 2.0 and share >= pure and surprise > least and both:
                kept[term] = odds
                break
    number = {t: int(c[0, :, 0].sum()) for t, c in stats.items()}
    chosen: dict[str, float] = {}
    for term in sorted(kept, key=lambda x: (len(x.strip()), x)):
        stem = term.rstrip()
        if any(stem[:n] in chosen for n in range(2, len(stem) + 1) if stem[:n] != term):
            continue
        # go on to the longest form that still covers nearly all of the documents
        form = term
        while not form.endswith(" "):
            longer = [x for x in kept if len(x) == len(form) + 1 and x.startswith(form)]
            best = max(longer, key=lambda x: number[x], default=None)
            if best is None or number[best] < 0.9 * number[form]:
                break
            form = best
        chosen[form] = kept[form]
    top = sorted(chosen, key=lambda x: (-chosen[x] * number[x], x))[:TERMS]
    largest = max((chosen[x] for x in top), default=1.0)
    return {x: chosen[x] / largest for x in top}


def fit_curve(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression on two features by Newton steps with a ridge penalty."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(3)
    ridge = np.diag([1e-6, penalty, penalty])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - ridge @ beta
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def held_out(doc_id: Column) -> Column:
    """Documents no label of which is ever learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, exceptions: Sequence[str] = EXCEPTIONS, sample: int = SAMPLE
) -> Model:
    """Learn a model from documents (doc_id, text) and labels (doc_id, toxic).

    NULL labels and ids and held-out documents are not used; a document labelled more
    than once counts once, as toxic if any label says so, and of rows that repeat an id
    one counts, the same one in any order, with a text if any has one. Without toxic or without other
    documents the default model is returned. Collected are terms and, for each sampled
    document, two numbers: both bounded by the parameters.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    sampled = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sampled = stored(sampled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labels")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    texts = texts.join(F.broadcast(sampled), F.col("id") == F.col("doc_id"))
    # one row per sampled id, by a hash, so that short texts are not preferred
    first = F.min(F.struct(F.col("text").isNull().alias("none"), F.xxhash64("text").alias("hash"), "text"))
    texts = texts.groupBy("id", "toxic").agg(first.alias("first")).select("first.text", "toxic")
    texts = stored(texts.repartition(sampled.sparkSession.sparkContext.defaultParallelism * 2), "labelled")

    counts = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    toxic, other = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not other:
        return default_model()
    spread = (
        texts.where("toxic = 1")
        .select("text")
        .mapInArrow(_contexts, "term string, context bigint")
        .distinct()
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= MIN_CONTEXTS)
        .orderBy(F.desc("n"), "term")
        .limit(CANDIDATES)
    )
    contexts = {r["term"]: r["n"] for r in spread.collect()}
    found = (
        texts.mapInArrow(_document_terms(set(contexts)), "term string, toxic int, half int, n bigint, often bigint")
        .groupBy("term", "toxic", "half")
        .agg(F.sum("n").alias("n"), F.sum("often").alias("often"))
        .collect()
    )
    stats = {t: np.zeros((2, 2, 2)) for t in contexts}
    for r in found:
        stats[r["term"]][:, r["half"], 0 if r["toxic"] == 1 else 1] += (r["n"], r["often"])
    terms = choose_terms(stats, contexts, toxic, other)
    if not terms:
        return default_model()
    model = Model(terms, tuple(exceptions))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [model.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[k] for p in pairs], pa.float64()) for k in (0, 1)] + [batch.column(1)],
                names=["x", "y", "toxic"],
            )

    # two numbers per sampled document; sorted, so that sums do not depend on who came first
    rows = texts.mapInArrow(features, "x double, y double, toxic int").toPandas()
    rows = rows.sort_values(["x", "y", "toxic"])
    model.curve = fit_curve(rows[["x", "y"]].to_numpy(), rows["toxic"].to_numpy().astype(float))
    return model


def score(text: Column, model: Model) -> Column:
    """The score of a text, 0 to 1; NULL and empty texts score as texts without terms."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return scores(text)
