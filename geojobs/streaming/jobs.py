"""Structured Streaming: arriving files and status feeds."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from geojobs.operators import catalog
from geojobs.operators.storage import open_store, settle

STATUS = "task_id bigint, status string, ts timestamp, event_id bigint, result string"


def inspect(files: DataFrame) -> DataFrame:
    """``files(path, length)`` -> path, extension, job, queue, length: what an upload's arrival starts."""
    name = F.element_at(F.split("path", "/"), -1)
    found = files.select("path", "length", catalog.ext_classify(name).alias("extension"))
    return catalog.route_inspect(found).select("path", "extension", "job", "queue", "length")


#: What is told of a file's content; all null where its kind isn't read or it can't be.
STATS = "lines bigint, points bigint, min_x double, min_y double, min_z double, max_x double, max_y double, max_z double"
#: Files that one batch takes: their paths pass through the driver.
BATCH_FILES = 10_000


def text_stats(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, STATS) of OBJ files: lines, vertices and their box. Large files are read by ranges, each by several tasks."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    words = F.when(F.col("value").startswith("v "), F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "))
    lines = lines.select("path", *[F.try_element_at(words, F.lit(i + 2)).try_cast("double").alias(f"_{c}") for i, c in enumerate("xyz")])
    known = F.col("_x").isNotNull() & F.col("_y").isNotNull() & F.col("_z").isNotNull()
    ends = [f(F.when(known, F.col(f"_{c}"))).alias(n + c) for n, f in (("min_", F.min), ("max_", F.max)) for c in "xyz"]
    return lines.groupBy("path").agg(F.count(F.lit(1)).alias("lines"), F.count(F.when(known, 1)).alias("points"), *ends)


def _heads(batches):
    """(path) -> (path, STATS) of LAS files from their headers alone; nulls for what is none."""
    import pyarrow as pa

    from geojobs.sources.files import las_header

    kinds = {n: pa.int64() if k == "bigint" else pa.float64() for n, k in (c.split() for c in STATS.split(", "))}
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            system, place = open_store(path)
            try:
                with system.open_input_file(place) as f:
                    data = f.read_at(min(375, f.size()), 0)
                box = struct.unpack_from("<6d", data, 179)
                rows.append((None, las_header(data)["count"], box[1], box[3], box[5], box[0], box[2], box[4]))
            except (ValueError, struct.error):
                rows.append((None,) * len(kinds))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())]], names=["path", *kinds])


def ingest(spark: SparkSession, path: str, checkpoint: str, sink: str) -> StreamingQuery:
    """Every file that arrives in ``path`` adds one row to the table at ``sink``, once per path: what ``inspect`` tells and STATS.

    Of OBJ files the lines are read, in ranges, of LAS files the headers, of others nothing. A batch takes BATCH_FILES files at most;
    one that runs again after a failure reads its files again and replaces its own folder.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", BATCH_FILES).load(path)

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = settle(inspect(batch))
        kinds = {k: [r["path"] for r in found.where(F.col("extension") == k).select("path").collect()] for k in (".obj", ".las")}
        stats = spark.createDataFrame([], "path string, " + STATS)
        if kinds[".obj"]:
            stats = stats.unionByName(text_stats(spark, kinds[".obj"]))
        if kinds[".las"]:
            heads = spark.createDataFrame([(p,) for p in kinds[".las"]], "path string")
            stats = stats.unionByName(heads.mapInArrow(_heads, "path string, " + STATS))
        # The same path may be written with one slash behind the scheme, or three.
        key = F.regexp_replace("path", "^file:/+", "file:/").alias("_key")
        rows = found.withColumn("_key", key).join(stats.withColumn("_key", key).drop("path"), "_key", "left").drop("_key")
        rows.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return files.select("path", "length").writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CHANGE = "task_id bigint, status string, ts bigint, event_id bigint, result string"
#: What the store keeps for a task: its latest event and its latest success; times in microseconds, NONE where there is none.
KEPT = "status string, ts bigint, event_id bigint, result string, result_ts bigint, result_id bigint"
NONE = -(1 << 63)


def _keep(key, frames, state):
    """A task's new events -> its current row, if they change it. Rows compare by event time and id, whatever their order."""
    import pandas as pd

    old = tuple(state.get) if state.exists else (None, NONE, NONE, None, NONE, NONE)
    status, ts, event, result, result_ts, result_id = old
    new = False
    for pdf in frames:
        for s, at, number, told in zip(*(pdf[c].tolist() for c in ("status", "ts", "event_id", "result"))):
            if (at, number) > (ts, event) or old[1] == NONE and not new:
                status, ts, event, new = s, at, number, True
            if s == "SUCCESS" and (at, number) > (result_ts, result_id):
                result, result_ts, result_id, new = told, at, number, True
    if new:
        state.update((status, ts, event, result, result_ts, result_id))
        yield pd.DataFrame({"task_id": pd.array([key[0]], "Int64"), "status": [status], "ts": [ts], "event_id": [event], "result": [result]})


def _told(ts: Column) -> Column:
    return F.when(ts != NONE, F.timestamp_micros(ts))


def status(spark: SparkSession, source: str, checkpoint: str, target: str) -> StreamingQuery:
    """Status events (Parquet files of STATUS) -> the state of each task, kept in the state store under ``checkpoint``, and the rows that a
    batch changes at ``target``/batch=n.

    Late and repeated events change nothing: rows compare by event time and id, null ones first, and a result is that of the last
    success. A batch writes in proportion to its events, and so does the store. ``checkpoint`` must be on a folder that all executors share.
    """
    events = spark.readStream.schema(STATUS).parquet(source)
    rows = events.select("task_id", "status", F.coalesce(F.unix_micros("ts"), F.lit(NONE)).alias("ts"), F.coalesce("event_id", F.lit(NONE)).alias("event_id"), "result")
    changes = rows.groupBy("task_id").applyInPandasWithState(_keep, CHANGE, KEPT, "update", GroupStateTimeout.NoTimeout)
    changes = changes.withColumns({"ts": _told(F.col("ts")), "event_id": F.when(F.col("event_id") != NONE, F.col("event_id"))})

    def write(batch: DataFrame, number: int) -> None:
        # A batch that runs again after a failure replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The current row of each task, from the store of the last finished batch; no earlier batch is read."""
    kept = spark.read.format("statestore").load(checkpoint).select("key.task_id", "value.groupState.*")
    return kept.select("task_id", "status", _told(F.col("ts")).alias("ts"), "result")
