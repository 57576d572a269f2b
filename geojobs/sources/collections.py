"""GeoJSON collections, one JSON document each, read by ranges of bytes.

Where a range stands in the document is told by sums over the ranges before it: whether it begins inside a string, and how many brackets
are open. Three narrow passes over the bytes: quotes and brackets of each range, the place of the array of features, and the features
that begin in each range, whose ends may lie in later ones.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geojobs.operators.storage import open_store, settle

RANGE = 8 << 20
#: Bytes that a task reads, range by range.
TASK = 8 << 20
QUOTE, BACKSLASH = 0x22, 0x5C
#: The key before the array of features; how far before the bracket it may begin.
KEY, NEAR = re.compile(rb'"features"\s*:\s*\Z'), 256


def _quotes(b: np.ndarray, before: int = 0) -> np.ndarray:
    """Which bytes are quotes that begin or end a string; ``before`` backslashes stand right before the first byte."""
    at = np.arange(b.size)
    last = np.maximum.accumulate(np.where(b != BACKSLASH, at, -1 - before)) if b.size else at
    run = at - 1 - np.concatenate(([-1 - before], last[:-1])) if b.size else at
    return (b == QUOTE) & (run % 2 == 0)


def _depths(b: np.ndarray, quotes: np.ndarray, inside: bool, depth: int) -> np.ndarray:
    """Open brackets after each byte."""
    text = (np.cumsum(quotes) + inside) % 2 == 1
    step = ((b == 0x7B) | (b == 0x5B)).astype(np.int64) - ((b == 0x7D) | (b == 0x5D))
    return depth + np.cumsum(np.where(text, 0, step))


def _load(f, start: int, end: int) -> tuple[np.ndarray, int]:
    """The bytes of a range, and how many backslashes stand right before it."""
    before, back = 0, start
    while back > 0:
        head = f.read_at(min(1024, back), back - min(1024, back))
        run = len(head) - len(head.rstrip(b"\\"))
        before += run
        back -= len(head)
        if run < len(head):
            break
    return np.frombuffer(f.read_at(end - start, start), np.uint8), before


def _each(columns: list[str], schema: str, work: Callable) -> Callable:
    """A function over Arrow batches: ``work(file, row)`` gives rows of ``schema`` for each range."""
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    kinds = [{"string": pa.string(), "long": pa.int64()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns)):
                system, path = open_store(row[0])
                with system.open_input_file(path) as f:
                    rows = list(work(f, row))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))

    return run


def _count(f, row) -> Iterator[tuple]:
    uri, start, end = row
    b, before = _load(f, start, end)
    quotes = _quotes(b, before)
    plain, other = (int(_depths(b, quotes, inside, 0)[-1]) if b.size else 0 for inside in (False, True))
    yield uri, start, end, int(quotes.sum() % 2), plain, other


def _arrays(f, row) -> Iterator[tuple]:
    """Where the array of features begins and where arrays of the root end."""
    uri, start, end, inside, depth = row
    b, before = _load(f, start, end)
    depths = _depths(b, _quotes(b, before), bool(inside), depth)
    was = np.concatenate(([depth], depths[:-1]))
    for at in np.flatnonzero((depths == 2) & (was == 1) & (b == 0x5B)).tolist():
        low = max(0, start + at - NEAR)
        if KEY.search(f.read_at(start + at - low, low)):
            yield uri, start + at, 1
    for at in np.flatnonzero((depths == 1) & (was == 2) & (b == 0x5D)).tolist():
        yield uri, start + at, 0


def _features(block: int) -> Callable:
    def run(f, row) -> Iterator[tuple]:
        uri, start, end, inside, depth, first, last = row
        b, before = _load(f, start, end)
        quotes = _quotes(b, before)
        depths = _depths(b, quotes, bool(inside), depth)
        was = np.concatenate(([depth], depths[:-1]))
        place = np.arange(start, start + b.size)
        within = (place > first) & (place < last)
        begins = np.flatnonzero((depths == 3) & (was == 2) & (b == 0x7B) & within)
        ends = np.flatnonzero((depths == 2) & (was == 3) & (b == 0x7D) & within)
        data, size = b.tobytes(), f.size()
        for k, at in enumerate(begins.tolist()):
            later = ends[np.searchsorted(ends, at) :]
            if later.size:
                yield uri, start, k, data[at : int(later[0]) + 1].decode("utf-8", "replace")
                continue
            parts, open_, text, to = [data[at:]], int(depths[-1]), bool((np.count_nonzero(quotes) + inside) % 2), end
            tail = len(data) - len(data.rstrip(b"\\"))
            while to < size:  # it goes on in later ranges
                more = f.read_at(min(block, size - to), to)
                c = np.frombuffer(more, np.uint8)
                q = _quotes(c, tail)
                d = _depths(c, q, text, open_)
                done = np.flatnonzero(d == 2)
                if done.size:
                    parts.append(more[: int(done[0]) + 1])
                    break
                parts.append(more)
                open_, text, tail, to = int(d[-1]), bool((np.count_nonzero(q) + text) % 2), len(more) - len(more.rstrip(b"\\")), to + len(more)
            yield uri, start, k, b"".join(parts).decode("utf-8", "replace")

    return run


#: What the root of a file says: a key of the collection, or the type of a feature.
ROOT = re.compile(rb'"(?:features"\s*:\s*\[|type"\s*:\s*"(Feature|FeatureCollection)")')


def _kind(f, row) -> Iterator[tuple]:
    """``lines`` if the first object is a feature, else ``collection``; its first bytes tell, more of them where those don't."""
    uri, length = row
    size = min(length, 1 << 16)
    while length:
        data = f.read_at(size, 0)
        b = np.frombuffer(data, np.uint8)
        quotes = _quotes(b)
        depths, text = _depths(b, quotes, False, 0), np.cumsum(quotes) - quotes
        said = next((m for m in ROOT.finditer(data) if depths[m.start()] == 1 and text[m.start()] % 2 == 0), None)
        if said is not None or size >= length:
            break
        size = min(length, 4 * size)
    if length:
        yield uri, length, "lines" if said is not None and said[1] == b"Feature" else "collection"


def kinds(files: DataFrame) -> DataFrame:
    """``files(file, length)`` -> file, length, kind (lines or collection); empty files are left out."""
    schema = "file string, length long, kind string"
    return files.mapInArrow(_each(["file", "length"], schema, _kind), schema)


def features(files: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """``files(file, length)`` of FeatureCollections -> (file, at, value): the features' JSON texts and their places from 0 in each file."""
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.select("file", "length", cuts.alias("start")).select("file", "start", F.least(F.col("start") + range_bytes, F.col("length")).alias("end"))
    # Small ranges share a task: starting one costs more than reading a few of them.
    size = ranges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("bytes")).first()
    tasks = max(1, min(size["n"], max(files.sparkSession.sparkContext.defaultParallelism, -(-(size["bytes"] or 0) // TASK))))
    dealt = ranges.repartition(tasks, "file", "start")
    counted = "file string, start long, end long, quotes long, plain long, other long"
    told = settle(dealt.mapInArrow(_each(["file", "start", "end"], counted, _count), counted))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    told = told.withColumn("inside", F.coalesce(F.sum("quotes").over(earlier) % 2, F.lit(0)))
    told = told.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("plain")).otherwise(F.col("other"))).over(earlier), F.lit(0)))
    told = settle(told.select("file", "start", "end", "inside", "depth"))
    marks = "file string, place long, opens long"
    found = settle(told.repartition(tasks, "file", "start").mapInArrow(_each(["file", "start", "end", "inside", "depth"], marks, _arrays), marks))
    # The array of features ends where the first array after its bracket does; a row for each file.
    begins = found.where("opens = 1").groupBy("file").agg(F.min("place").alias("first"))
    lasts = found.where("opens = 0").join(begins, "file").where("place > first").groupBy("file", "first").agg(F.min("place").alias("last"))
    whole = told.join(lasts, "file").where("start < last and end > first").repartition(tasks, "file", "start")
    texts = "file string, start long, k long, value string"
    rows = settle(whole.mapInArrow(_each(["file", "start", "end", "inside", "depth", "first", "last"], texts, _features(range_bytes)), texts))
    sizes = rows.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("file", "start", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return rows.join(sizes, ["file", "start"]).select("file", (F.col("k") + F.col("before")).alias("at"), "value")
