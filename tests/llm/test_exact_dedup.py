import hashlib

from cases import LONG, SF, TEXTS, awkward, lower
from compare import compare, connect

from assaylens.llm import exact_dedup
from assaylens.llm.queries import QUERIES, SQL


def test_query_against_sql(spark):
    df = QUERIES["op9_exact_dedup"](spark, SF)
    assert compare(df, connect(SF), SQL["op9_exact_dedup"]) is None


def test_awkward_documents(spark):
    rows = exact_dedup.classes(awkward(spark), keep="largest").collect()
    assert len(rows) == len(TEXTS)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text_sha256, []).append(r)
    digest = lambda t: hashlib.sha256(lower(t).encode()).hexdigest()
    assert set(by_text) == {digest(t) for _, t in TEXTS}
    empty = by_text[digest("")]
    assert {(r.id, r.keep_id, r.group_size, r.kept) for r in empty} == {
        (2, 9, 3, False), (3, 9, 3, False), (9, 9, 3, True)
    }
    same = by_text[digest("same text, twice")]
    assert [r.kept for r in same].count(True) == 1 and {r.keep_id for r in same} == {5}
    assert by_text[digest("no identifier here")][0].kept
    assert by_text[digest(LONG)][0].group_size == 1


def test_repeated_row_keeps_one(spark):
    df = awkward(spark, [(1, "x")] * 5 + [(2, "X")])
    assert [r.doc_id for r in exact_dedup.deduplicate(df).collect()] == [1]
    assert [r.doc_id for r in exact_dedup.deduplicate(df, keep="largest").collect()] == [2]


def test_columns_stay_and_empty_tables_work(spark):
    df = awkward(spark)
    out = exact_dedup.deduplicate(df)
    assert out.dtypes == df.dtypes and out.count() == 7
    assert exact_dedup.deduplicate(df.limit(0)).count() == 0
    assert exact_dedup.classes(df.limit(0)).count() == 0


def test_rounds_give_the_same_as_one(spark):
    df = awkward(spark, [(i, f"t{i % 7}") for i in range(200)]).repartition(16)
    rows = exact_dedup.digest_rows(df)
    few, many = (
        {(r.sha, r.best.id, r.n) for r in exact_dedup.merge_runs(rows, "largest", f).collect()} for f in (2, 1000)
    )
    assert few == many and len(few) == 7
