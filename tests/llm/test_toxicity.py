import math
import random
import zlib

import numpy as np
from cases import SF, TEXTS, awkward
from pyspark.sql import functions as F

from assaylens.llm import toxicity
from assaylens.llm.queries import QUERIES


def test_folding():
    assert toxicity.fold("M0r0n, you ID!OT! çà et là") == " moron you idiot ca et la "
    assert toxicity.fold("ｓｔｕｐｉｄ мoron st​upid") == " stupid moron stupid "
    assert toxicity.fold("call 555-1234 at a@b.com") == " call at a b com "
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold("\n 1 2 ") == "  "
    assert len(toxicity.fold("x" * 1_000_000)) == 1_000_002
    assert len(toxicity.fold("@" * 300_000 + " " + "1a" * 300_000)) > 0


def test_terms_and_exceptions():
    model = toxicity.Model({" trash ": 1.0, " lowei": 1.0}, ("trash can",))
    assert model.features("the trash can is full") == (0.0, 0.0)
    assert model.features("trash trash can")[0] > 0
    assert model.features("loweischaft")[0] > 0 and model.features("flowei")[0] == 0
    assert model.score("trash trash you") > model.score("trash" + " word" * 500)


def test_known_words_are_folded_whatever_their_share_of_letters():
    model = toxicity.Model({" idiot ": 1.0, " stoi": 1.0, " ass ": 1.0})
    assert model.features("you 1d10t, you") == model.features("you idiot, you") != (0.0, 0.0)
    assert model.features("5701c5")[0] > 0
    # numbers and unknown codes stay
    assert model.features("455 a55x 1d10tx7 10.4") == (0.0, 0.0)
    assert toxicity.fold("1d10t b2b4c5") == toxicity.fold("1d10t b2b4c5", lambda w: False)


def plain_held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 0


def test_query(spark):
    rows = QUERIES["op8_toxicity"](spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 200
    assert all(r.held_out == plain_held_out(r.doc_id) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    scored = [(r.score, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    good = sum(a > b for a, x in scored for b, y in scored if x > y)
    assert good >= 0.6 * sum(x > y for _, x in scored for _, y in scored)


def plain_score(text, model):
    """A score without the automaton: every term looked for by itself."""
    folded = toxicity.fold(text, model.knows)
    places = lambda t: [k for k in range(len(folded)) if folded.startswith(t, k)]
    spared = [(k, k + len(e) + 2) for e in model.exceptions for k in places(f" {e} ")]
    total = sum(
        w for t, w in model.terms.items() for k in places(t) if not any(a <= k and k + len(t) <= b for a, b in spared)
    )
    a, b, c = model.curve
    z = a + b * math.log1p(total) + c * math.log1p(100 * total / max(1, len(folded.split())))
    return 1 / (1 + math.exp(-z))


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op8_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    toxic = [r for r in rows if labels[r.doc_id]]
    # some labels say toxic of documents without any insult, so not all can be found
    assert len(toxic) > 90 and sum(r.predicted for r in toxic) >= 0.9 * len(toxic)
    assert sum(r.predicted for r in rows if not labels[r.doc_id]) <= 0.01 * len(rows)


def test_scores_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = docs.select("text", toxicity.score(docs["text"], model).alias("s")).collect()[::7]
    assert all(abs(r.s - plain_score(r.text, model)) < 1e-9 for r in rows if len(r.text or "") < 5000)


def test_stems_that_are_common_but_seldom_frequent(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abdegiklnorstuvz") for _ in range(rng.randint(3, 7)))
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(80)]
        stems = rng.randint(3, 6) if i % 6 == 0 else int(rng.random() < 0.4)
        for _ in range(stems):
            words[rng.randrange(80)] = "vrex" + word()
        docs.append((i, " ".join([*words, *(["filler"] * 100 if i % 6 else [])])))
        labels.append((i, int(i % 6 == 0)))
    docs, labels = awkward(spark, docs), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert list(model.terms) == [" vrex"]
    scores = docs.select("doc_id", toxicity.score(docs["text"], model).alias("s")).collect()
    assert sum((r.s >= 0.5) == (r.doc_id % 6 == 0) for r in scores) >= 0.97 * len(scores)


def test_terms_of_one_half_only_are_none():
    counts = np.zeros((2, 2, 2))
    counts[0, 0, 0] = 60
    assert toxicity.choose_terms({" x ": counts}, {" x ": 50}, 100, 900) == {}
    counts[0, 1, 0] = 60
    assert list(toxicity.choose_terms({" x ": counts}, {" x ": 50}, 200, 900)) == [" x "]


def made_up(spark, n=400):
    filler = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    docs, labels = [], []
    for i in range(n):
        words = [filler[(i * 7 + k * k) % 10] for k in range(30)]
        toxic = i % 8 == 0
        if toxic:
            words[i % 29] = ("grobnak", "grobnix", "vilespeak")[i % 3]
            words[(i * 5) % 29] = "vilespeak"
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return awkward(spark, docs), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_learns_words_and_generalises(spark):
    docs, labels = made_up(spark)
    model = toxicity.fit(docs, labels)
    assert " vilespeak " in model.terms and not any("alpha" in t for t in model.terms)
    scores = docs.select("doc_id", toxicity.score(docs["text"], model).alias("s")).collect()
    assert all((r.s >= 0.5) == (r.doc_id % 8 == 0) for r in scores)
    assert toxicity.fit(docs.repartition(5), labels.repartition(3)) == model


def test_repeated_ids_count_once(spark):
    docs, labels = made_up(spark)
    other = docs.where("doc_id = 1")
    assert not plain_held_out(1) and other.count()
    many = docs.unionByName(other.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(3000)))).select(docs.columns))
    many = many.unionByName(other.withColumn("text", F.lit(None).cast("string")))
    assert toxicity.fit(many, labels) == toxicity.fit(docs, labels)


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = made_up(spark)
    changed = labels.selectExpr(
        "doc_id", "CASE WHEN pmod(crc32(cast(cast(doc_id AS string) AS binary)), 5) = 0 THEN 1 - toxic ELSE toxic END AS toxic"
    )
    assert toxicity.fit(docs, changed) == toxicity.fit(docs, labels)


def test_awkward_documents_and_empty_tables(spark):
    df = awkward(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(df, labels)
    assert model == toxicity.default_model() == toxicity.fit(df.limit(0), labels.limit(0))
    rows = df.select(toxicity.score(df["text"], model).alias("s")).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.s < 0.5 for r in rows)
