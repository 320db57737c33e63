from pyspark.sql import functions as F

from assaylens.operators import files as file_ops
from assaylens.operators import predicates as p
from assaylens.sources import store


def measurements(spark, n, accession):
    return spark.range(n).select(
        accession.alias("accession"),
        F.lit("rna").alias("assay_name"),
        F.concat(F.lit("s"), (F.col("id") % 10).cast("string")).alias("sample_name"),
        F.concat(F.lit("g"), F.col("id").cast("string")).alias("feature"),
        F.col("id").cast("double").alias("value"),
    )


def test_only_the_selected_datasets_are_read(spark, tmp_path):
    path = str(tmp_path / "m")
    name = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("D-"), (F.col("id") % 5).cast("string")))
    store.write_measurements(measurements(spark, 3000, name), path)
    samples = spark.createDataFrame(
        [("D-1", "rna", "s1", {"study.factor value.x": "a"}), ("hot", "rna", "s1", {})],
        "accession string, assay_name string, sample_name string, attrs map<string,string>",
    )
    chosen = p.filter_samples(samples, [p.exists("study.factor value.x")])
    kept = file_ops.select_measurements(store.read_datasets(spark, path), chosen)
    assert {r["accession"] for r in kept.collect()} == {"D-1"}
    assert kept.count() == len([i for i in range(3000) if i % 3 and i % 5 == 1 and i % 10 == 1])


def test_a_dataset_is_replaced_and_the_others_stay(spark, tmp_path):
    path = str(tmp_path / "m")
    store.write_measurements(measurements(spark, 20, F.concat(F.lit("01"), (F.col("id") % 2).cast("string"))), path)
    store.write_measurements(measurements(spark, 3, F.lit("010")), path)
    stored = store.read_datasets(spark, path)
    assert dict(stored.dtypes)["accession"] == "string"
    counts = {r["accession"]: r["count"] for r in stored.groupBy("accession").count().collect()}
    assert counts == {"010": 3, "011": 10}


def test_filters_on_the_partition_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "m")
    store.write_measurements(measurements(spark, 20, F.lit("D-1")), path)
    chosen = store.read_datasets(spark, path).filter("accession = 'D-1' AND feature = 'g3'").select("value")
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(accession" in plan
    assert "EqualTo(feature,g3)" in plan
    assert "ReadSchema: struct<feature:string,value:double>" in plan
