"""The pipeline's stages, each held against what it should keep."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from locusweave.llm import decontaminate, langid, simhash
from locusweave.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    bad = spark.createDataFrame([(900, "1234 5678", "en", "s", 9), (901, None, "en", "s", 0)], docs.schema)
    twin = docs.where("doc_id = 3").withColumn("doc_id", F.lit(902).cast("long"))
    docs = docs.unionByName(bad).unionByName(twin)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        seen[name] = {r.doc_id for r in docs.select("doc_id").distinct().collect()}
        if name == "language_id":
            assert docs.columns == columns and not seen[name] & {900, 901} and len(seen[name]) > 190
        elif name == "line_dedup":
            assert docs.columns == columns
            lines = [x.strip().lower() for r in docs.collect() for x in r.text.split("\n") if x.strip()]
            assert len(lines) == len(set(lines)) and 902 not in seen[name]
        elif name == "simhash_dedup":
            c = simhash.classes(before)
            assert seen[name] == {r.component_id for r in c.collect()} and docs.count() == len(seen[name])
        elif name == "decontamination":
            hit = decontaminate.digest(before, table(spark, SF, "benchmark")).where("contaminated")
            assert seen[name] == {r.doc_id for r in before.collect()} - {r.doc_id for r in hit.collect()}
        else:
            assert seen[name] == {r.doc_id for r in before.collect()}
            assert docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048
    assert len(corpus_pipeline.STAGES) == 5


def test_texts_without_doc_id_stay(spark):
    rows = [(None, "the river and the green house by the water were in light"), (None, "a stone that was in the house of the green river by night"), (4, "the light of water was on the stone and as green as with that river")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, SF)
    assert sorted(r.text for r in docs.collect()) == sorted(t for _, t in rows)


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)


@pytest.mark.parametrize("empty", [True])
def test_empty_table(spark, empty):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0 and langid.fit(table(spark, SF, "documents").limit(0)).languages == []
