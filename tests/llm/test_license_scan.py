from cases import LONG, SF, TEXTS, awkward, documents, words

from assaylens.llm import license_scan
from assaylens.llm.queries import QUERIES

PHRASES = [(p.label, words(p.text)) for p in license_scan.PHRASES]


def plain(text):
    ws = words(text)
    places = [(i, label) for label, p in PHRASES for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return (
        len(ws), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({label for _, label in places})),
    )


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_query_against_brute_force(spark):
    texts = dict(documents(spark))
    rows = QUERIES["op7_license_scan"](spark, SF).collect()
    assert {r.doc_id: base(r) for r in rows} == {i: plain(t) for i, t in texts.items()}
    assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels for r in rows)
    assert all((r.score > 0) == (r.labels != "") and 0 <= r.score <= 1 for r in rows)


def test_altered_notices_and_repeats(spark):
    mit = license_scan.NOTICES[0].text
    cut = mit.replace("free of charge", "").replace("persons", "people").replace("merge", "combine")
    docs = [
        (1, mit), (2, f"x y z {cut} end"), (3, " ".join(mit.split()[:8])), (4, "cc-by-nc CC BY NC cc by  nc"),
        (5, "Released under the MIT License. Apache License, Version 2.0"),
        (6, "released under the GNU General Public License, version 3."), (7, mit + " filler" * 50 + " " + mit),
        (8, "cc by cc by nc"), (9, LONG + "All rights reserved"),
    ]
    rows = {r.id: r for r in license_scan.scan(awkward(spark, docs)).collect()}
    for i, t in docs:
        assert base(rows[i]) == plain(t)
    assert rows[1].labels == "mit" and rows[1].score == 1 and rows[1].base_labels == ""
    assert rows[2].labels == "mit" and 0.7 <= rows[2].score < 1
    assert rows[3].labels == "" and rows[3].score == 0
    assert rows[4].n_base == 3 and rows[5].labels == "apache-2,mit"
    assert rows[6].labels == "gpl-3" and rows[7].labels == "mit" and rows[9].labels == "all-rights-reserved"


def test_awkward_documents(spark):
    df = awkward(spark)
    rows = license_scan.scan(df).collect()
    assert sorted(r.n_words for r in rows) == sorted(len(words(t)) for _, t in TEXTS)
    assert all((r.labels, r.score) == ("", 0) for r in rows)
    assert license_scan.scan(df.limit(0)).count() == 0


def test_time_is_in_proportion_to_the_length(spark):
    """A word more costs the same in a long text as in a short one."""
    import time

    text = "some plain words and the mit license of it " * 36_000  # 324,000 words
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    start = time.perf_counter()
    found = license_scan.scan(docs).collect()
    assert time.perf_counter() - start < 30
    assert found[0].n_words == 324_000
