import random

from cases import LONG, SF, TEXTS, awkward, words
from compare import compare, connect

from assaylens.llm import decontaminate
from assaylens.llm.queries import QUERIES, SQL


def plain(text, items, size=10):
    ws, hit, found = words(text), set(), set()
    for item, t in items:
        iw = words(t)
        k = min(size, len(iw))
        windows = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)} if k else set()
        for p in range(len(ws) - k + 1) if k else ():
            if tuple(ws[p : p + k]) in windows:
                hit.update(range(p, p + k))
                found.add(str(item))
    return len(ws), len(hit), ",".join(sorted(found))


def test_query_against_sql(spark):
    df = QUERIES["op3_decontamination"](spark, SF)
    assert compare(df, connect(SF), SQL["op3_decontamination"]) is None


def benchmark(spark, items):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, item string, n int")


def test_few_words_many_overlaps(spark):
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    docs = [(i, some(rng.randint(0, 60))) for i in range(60)]
    items = [(i, some(rng.randint(0, 14))) for i in range(12)] + [(3, "a b"), (None, "c c c"), (50, None), (51, "")]
    for size, rarest in ((10, 3), (4, 2), (3, 5)):
        found = decontaminate.report(awkward(spark, docs), benchmark(spark, items), size, rarest).collect()
        got = {r.id: (r.n_words, r.n_hit, r.items) for r in found}
        for i, t in docs:
            listed = plain(t, [x for x in items if x[0] is not None], size)
            assert got[i][0] == listed[0] and got[i][2] == listed[2]
            assert got[i][1] == plain(t, items, size)[1]


def test_awkward_documents(spark):
    items = [(1, "TWO three, four five six seven eight nine ten eleven twelve"), (2, "same text"), (10, "dog again the")]
    rows = decontaminate.report(awkward(spark), benchmark(spark, items)).collect()
    assert len(rows) == len(TEXTS)
    by_id = {r.id: r for r in rows}
    assert (by_id[1].n_hit, by_id[1].items) == (10, "1")
    assert (by_id[4].n_hit, by_id[4].n_words) == (2, 3)
    assert by_id[7].n_hit == 3 * (len(words(LONG)) // 10 - 1) and by_id[7].items == "10"
    assert all(by_id[i].n_words == 0 for i in (2, 3, 6, 9))
    df = awkward(spark)
    out = decontaminate.clean(df, benchmark(spark, items))
    assert out.dtypes == df.dtypes and sorted(r.doc_id or 0 for r in out.collect()) == [0, 2, 3, 6, 8, 9]


def test_empty_tables(spark):
    df, none = awkward(spark), benchmark(spark, [])
    assert decontaminate.report(df.limit(0), benchmark(spark, [(1, "a b")])).count() == 0
    rows = decontaminate.report(df, none).collect()
    assert len(rows) == len(TEXTS) and not any(r.n_hit for r in rows)


def test_proximity(spark):
    docs = awkward(spark, [(1, "x b a c x"), (2, "a x x x x x x b c"), (3, "a b"), (4, "c a b")])
    words_ = decontaminate.items(benchmark(spark, [(1, "a b c")]))
    terms = decontaminate.vocabulary(words_)
    postings = decontaminate.index(docs, terms)
    ids = {r.row: r.id for r in postings.where("term = -1").collect()}
    found = decontaminate.proximity(postings, words_, terms, slop=2).collect()
    assert {ids[r.row] for r in found} == {1}
    found = decontaminate.proximity(postings, words_, terms, slop=3).collect()
    assert {ids[r.row] for r in found} == {1, 4}
