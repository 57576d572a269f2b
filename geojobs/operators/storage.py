"""Shared storage: cutting lineage in the folder of ``spark.checkpoint.dir``, and paths that mean the same on every machine.

Whoever sets the folder clears it when the application has ended: results are read from it until then. The temporary folder that
stands in on a single machine goes with the driver.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A fresh path in the shared folder. Where that is unset, a temporary one on a local master; elsewhere an error, since every
    executor would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="geojobs-checkpoint-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return qualified(spark, f"{base.rstrip('/')}/{uuid.uuid4().hex}")


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: iterations neither grow their plan nor lose work with an executor."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int = 5_000) -> DataFrame:
    """``df`` dealt over tasks of some ``rows`` rows. For work that costs far more than its rows weigh: Spark cuts files by bytes, so
    that a million narrow rows come in a task or two."""
    return df.repartition(max(1, -(-df.count() // rows)))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of Spark's default store if it has none, so that tasks that open it themselves mean what Spark means."""
    if ":" in path.split("/")[0]:
        return path
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toString()


def open_store(uri: str):
    """(Arrow file system, path in it) of a qualified path."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"{uri} has no scheme: pass it through qualified()")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(("s3" if scheme in ("s3a", "s3n") else scheme) + ":" + rest)
