import zlib
from collections import Counter, defaultdict

import numpy as np
from cases import awkward, documents, lower
from test_decontaminate import plain as plain_hits
from test_packing import check_places
from test_simhash import plain_components, plain_fingerprint

import corpus_pipeline
from assaylens.llm import packing, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_and_registration():
    import __spark_entry__ as entry

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "decontamination", "packing"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [n.split("_")[0] for n in entry.queries() if n.startswith("op")] == [f"op{k}" for k in range(1, 14)]
    assert "pipeline" not in entry.oracle_sql()


def test_against_brute_force(spark):
    docs = sorted(documents(spark))
    model = toxicity.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    left = [(i, t) for i, t in docs if model.score(t) < 0.5]
    largest = {lower(t): i for i, t in left}
    left = [(i, t) for i, t in left if largest[lower(t)] == i]
    label = plain_components([plain_fingerprint(t) for _, t in left])
    left = [d for k, d in enumerate(left) if label[k] == k]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = [(i, t) for i, t in left if not plain_hits(t, items)[1]]
    assert len(left) < len(docs)
    expected = Counter()
    for i, t in left:
        ids = np.array([*packing.Tokens().slow(t or ""), 0], dtype="<u4")
        for k, (a, n) in enumerate(packing.cuts(len(ids), 2048)):
            expected[i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    check_places(rows)


def test_stages_keep_columns_and_empty_tables(spark):
    df = awkward(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        assert out.dtypes == df.dtypes
        assert stage(spark, df.limit(0), SF).count() == 0
    groups = defaultdict(int)
    for r in corpus_pipeline.drop_exact_copies(spark, df, SF).collect():
        groups[lower(r.text)] += 1
    assert set(groups.values()) == {1}
