import corpus_pipeline
from casewise.llm.dedup import near_duplicate_classes
from casewise.llm.pii import base_spans
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF)
        after.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "packing":
            assert after.select("doc_id").distinct().count() == before.count()
            break
        assert after.columns == columns and after.count() <= before.count()
        if name == "language":
            assert after.count() == before.where(F.col("text").rlike(r"\p{L}")).count()
        if name == "dedup":
            classes = near_duplicate_classes(before).select("class_id").distinct().count()
            assert after.count() == classes
        if name == "pii":
            assert after.where(F.size(base_spans(F.col("text"))) > 0).count() == 0
            same = after.alias("a").join(before.alias("b"), "doc_id").where(F.size(base_spans(F.col("b.text"))) == 0)
            assert same.where("a.text != b.text").count() == 0
        before = after


def test_tables_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []
