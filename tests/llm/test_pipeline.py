"""The stages one after the other on a small table, each against what it may and may not do."""

from pyspark.sql import functions as F

import corpus_pipeline as P


def test_stages(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs, seen = source, []
    for name, stage in P.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == source.columns
        if name in ("toxicity", "quality", "near_duplicates"):
            assert out.count() <= docs.count() and out.join(docs, "doc_id", "left_anti").count() == 0
        if name == "near_duplicates":
            assert out.count() == out.select("doc_id").distinct().count()
        seen.append(out.count())
        docs = out
    assert [n for n, _ in P.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"] and min(seen) > 0
    assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
