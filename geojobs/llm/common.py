"""What several operators need: shared storage, table reading, hold-out split, Arrow batches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geojobs.operators.storage import settle as stash, shared_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 3 is 1: rows that no fit may see. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(text, label) of at most ``max_rows`` rows of labelled documents that aren't held out, those of the smallest id hashes.

    The bound is the only sample in a fit and proves the size of the broadcast. Of repeated labels of a document the larger holds; of
    repeated rows of a document one is learned from, that of the smallest text hash, so that the bound holds for rows as well.
    """
    ids = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_y"))
        .where(~held_out(F.col("_id")) & F.col("_y").isNotNull())
        .groupBy("_id").agg(F.max("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    texts = docs.select(F.col("doc_id").alias("_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("_y").alias("label"))
    return found.select("text", "label")


def small_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the strings of ``column`` hold about ``max_bytes`` each; single rows stay whole.

    Workers serve one task after another: at the end of one, Arrow gives back what it holds.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        rows = max(1, int(batch.num_rows * max_bytes / max(1, col.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch, col
    pa.default_memory_pool().release_unused()


def at_most(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows. It is counted, so pass what is written down."""
    return F.broadcast(df) if df.count() <= rows else df


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """Inner join on ``key``, which is unique in ``right`` but may stand in a share of all rows of ``left``, which is written down.

    A key with more than a quarter of a partition's share is spread over as many salts as it has shares, dealt by ``by``. There are at
    most four times as many such keys as shuffle partitions, and as many copies of their rows of ``right`` again.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, left.count() // (4 * tasks))
    hot = stash(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share).select(key, F.ceil(F.col("_n") / share).cast("long").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1).cast("long"))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts)).drop("_salts")
    copies = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts")
    return dealt.join(copies, [key, "_salt"]).drop("_salt")


def worker_kept(name: Hashable, make: Callable):
    """What ``make`` gives, made once in a worker and kept over its tasks."""
    kept = sys.modules.setdefault("geojobs_worker_kept", types.ModuleType("geojobs_worker_kept")).__dict__
    if name not in kept:
        kept[name] = make()
    return kept[name]
