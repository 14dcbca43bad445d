from pyspark.sql import functions as F

import corpus_pipeline


def test_each_stage_reads_what_the_last_one_wrote(spark, monkeypatch):
    seen = []

    def stage(name):
        def run(spark, docs, sf_dir):
            seen.append(docs.inputFiles())
            return docs.withColumn("doc_id", F.col("doc_id") + 1)

        return name, run

    docs = spark.range(3).withColumnRenamed("id", "doc_id")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: docs)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("first"), stage("second")])
    out = corpus_pipeline.run(spark, "unused")
    assert seen[0] == [] and seen[1] and all("/first/" in f for f in seen[1])
    assert all("/second/" in f for f in out.inputFiles()) and out.inputFiles()
    assert sorted(r.doc_id for r in out.collect()) == [2, 3, 4]
