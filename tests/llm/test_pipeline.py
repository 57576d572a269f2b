from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from geojobs.llm import decontam, queries, simhash, toxicity


def test_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash", "decontamination", "packing"]
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_each_stage_on_the_one_before(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, small).cache()
        assert kept.columns == docs.columns and kept.join(docs, docs.columns, "left_anti").isEmpty()
        docs = kept
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > sizes[0] / 3
    assert decontam.contaminated(docs, spark.read.parquet(f"{small}/benchmark.parquet")).isEmpty()
    assert simhash.near_duplicates(docs).select("component_id").distinct().count() == docs.count()
    packed = corpus_pipeline.pack(spark, docs, small)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert toxicity.THRESHOLD == 0.7


def test_odd_documents_and_clashing_columns(spark, small, make, odd):
    """Nulls, empty and very long texts, repeated rows and columns with names that stages use: rows go or stay as they are."""
    rows = odd + [(7, "Some plain words stand here, and a few more follow them.")]
    docs = make(rows).withColumns({"_row": F.lit("a"), "row_": F.lit(1), "_doc": F.lit(2), "_mark": F.lit(3), "fp": F.lit(4), "component_id": F.lit(5), "label": F.lit(6), "predicted": F.lit(7), "key": F.lit(8)})
    whole = sorted(map(str, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, small)
        found = sorted(map(str, kept.collect()))
        assert kept.columns == docs.columns and not Counter(found) - Counter(whole)
        if name == "simhash":
            assert len(found) == 5  # one row of each text; the empty ones are one
        if name == "decontamination":
            assert found == whole
    packed = corpus_pipeline.pack(spark, docs, small).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows)


def test_empty_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0
