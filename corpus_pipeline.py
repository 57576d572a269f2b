"""The corpus pipeline: toxicity, quality, near-duplicates, decontamination, packing.

Every stage works on all that the one before kept and reads its own labels or benchmark from ``sf_dir``. All but the last return the
columns of ``documents`` (and whatever else their input has, whatever its name), so that rows can be dropped but not changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geojobs.llm import decontam, packing, quality, queries, simhash, toxicity
from geojobs.llm.common import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more for toxicity go.

    Null and empty texts have no evidence and stay; repeated rows score alike; very long texts are scored whole. Labels of documents
    that an earlier stage dropped aren't learned from; without labels of both kinds all stay. An empty table stays empty.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(toxicity.score(F.col("text"), model) < toxicity.THRESHOLD)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 for quality go.

    Null texts count as empty ones, which are scored like others; repeated rows score alike. Without labels of both kinds all stay.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), model) >= quality.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that of the smallest doc_id (null last), ties by the order of the rows.

    Null, empty and blank texts have one fingerprint and are one component; of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover half of a benchmark item or more go.

    Null and empty texts stay, as do all without a benchmark; repeated rows go or stay together; null item ids are items too.
    """
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all that was kept, packed into sequences: every row gives one piece at least, an empty text its end id."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("simhash", near_duplicates),
    ("decontamination", decontaminate),
    ("packing", pack),
]
#: No stage can be told in SQL: fitted models, XXH64 fingerprints, tilings and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = shared_dir(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
