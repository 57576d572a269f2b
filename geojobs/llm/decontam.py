"""Benchmark decontamination by greedy string tiling.

Seeds are runs of five tokens that a document shares with a benchmark item. A bitmap of the items' seeds, of bounded size, tells in
one pass over the documents which runs of tokens may matter; only those are joined with the seeds themselves. Documents whose seeds
could cover enough of an item are tiled against it: the longest common passages first, found by Karp-Rabin hashes, each token in one
tile at most. The share of the item that tiles cover, in whatever order they stand in the document, decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geojobs.llm.common import at_most, small_batches, spread_join, stash

WORDS = re.compile(r"\w+")
MIN_MATCH = 5
COVERAGE = 0.5
#: The bitmap has 512 bits a seed, but no fewer and no more than these powers of two (16 MB); beyond, more runs pass it and the join tells.
MIN_BITS, MAX_BITS = 16, 27
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


class Tokens:
    """Lower-cased words as 64-bit numbers; remembers them."""

    def __init__(self, cache: int = 150_000):
        self.cache, self.known = cache, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORDS.findall((text or "").lower())
        if len(self.known) > self.cache:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out) if n else out


def window_hashes(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of ``size`` tokens, modulo 2^64: differences of a running sum, shifted to one place."""
    n = tokens.size - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens * _powers(BASE, tokens.size), dtype=np.uint64)))
    return (sums[size:] - sums[:-size]) * _powers(INVERSE, n)


def _probes(seeds: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mixed = (seeds ^ seeds >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed >> np.uint64(64 - bits), (mixed * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - bits)


def tiles(pattern: np.ndarray, runs: list[np.ndarray], min_match: int = MIN_MATCH) -> list[tuple[int, int, int, int]]:
    """Greedy tiles ``(length, place in the pattern, run, place in the run)``: longest first, ties by places, none overlapping."""
    free_p, free_r, made = np.ones(pattern.size, bool), [np.ones(r.size, bool) for r in runs], []

    def open_windows(free: np.ndarray, size: int) -> np.ndarray:
        taken = np.concatenate(([0], np.cumsum(~free)))
        return np.flatnonzero(taken[size:] == taken[:-size]) if free.size >= size else np.empty(0, np.int64)

    size = max(min_match, min(32, pattern.size))
    while pattern.size >= min_match:
        starts: dict[int, list[int]] = {}
        hashes = window_hashes(pattern, size)
        for p in open_windows(free_p, size).tolist():
            starts.setdefault(int(hashes[p]), []).append(p)
        found, end = [], {}
        for k, run in enumerate(runs):
            if run.size < size or not starts:
                continue
            hashes = window_hashes(run, size)
            places = open_windows(free_r[k], size)
            for t in places[np.isin(hashes[places], np.fromiter(starts, np.uint64, len(starts)))].tolist():
                for p in starts[int(hashes[t])]:
                    if end.get((k, t - p), -1) > t:
                        continue  # within the match that began further up
                    n = min(pattern.size - p, run.size - t)
                    same = (pattern[p : p + n] == run[t : t + n]) & free_p[p : p + n] & free_r[k][t : t + n]
                    n = n if same.all() else int(same.argmin())
                    if n >= size:
                        end[(k, t - p)] = t + n - size + 1
                        found.append((-n, p, k, t))
        longest = max((-m[0] for m in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        marked = False
        for n, p, k, t in sorted(found):
            n = -n
            if free_p[p : p + n].all() and free_r[k][t : t + n].all():
                free_p[p : p + n] = False
                free_r[k][t : t + n] = False
                made.append((n, p, k, t))
                marked = True
        if marked:
            continue  # what was cut by a longer tile may still hold one of this size
        if size == min_match:
            break
        size = max(min_match, size // 2)
    return made


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, text) -> item_id, item (tokens), key (their hash with the id)."""
    for batch in batches:
        make = Tokens()
        tokens = [make(t) for t in batch.column(1).to_pylist()]
        keys = [xxhash.xxh3_64_intdigest(f"{i}:".encode() + t.tobytes()) for i, t in zip(batch.column(0).to_pylist(), tokens)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([t.view(np.int64) for t in tokens], pa.list_(pa.int64())), pa.array(np.array(keys, np.uint64).view(np.int64))], names=["item_id", "item", "key"]
        )


def _seeds(min_match: int, keys: tuple[str, str, str]) -> Callable:
    """(id, tokens) -> one row per distinct window of a sequence: its id, the hash, how often it occurs. A shorter one is its own window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seeds, counts = [], [], []
            for i, tokens in zip(batch.column(0).to_pylist(), batch.column(1)):
                line = np.asarray(tokens.values.to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
                found, n = np.unique(window_hashes(line, min(min_match, max(1, line.size))), return_counts=True)
                ids += [i] * found.size
                seeds.append(found.view(np.int64))
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(seeds) if seeds else [], pa.int64()), pa.array(np.concatenate(counts) if counts else [], pa.int64())], names=list(keys))

    return run


def _runs(bitmap, bits: int, min_match: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, words = Tokens(), bitmap.value
        for batch in small_batches(batches, "text"):
            docs, marks, starts, tokens = [], [], [], []
            for doc, text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                line = make(text)
                hashes = window_hashes(line, min(min_match, max(1, line.size)))
                one, two = _probes(hashes, bits)
                hit = np.flatnonzero((words[one >> np.uint64(6)] >> (one & np.uint64(63))) & (words[two >> np.uint64(6)] >> (two & np.uint64(63))) & np.uint64(1))
                if hit.size:
                    cuts = np.flatnonzero(np.diff(hit) > 1) + 1
                    for part in np.split(hit, cuts):
                        docs.append(doc)
                        marks.append(mark)
                        starts.append(int(part[0]))
                        tokens.append(line[part[0] : part[-1] + min_match].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(marks, pa.int64()), pa.array(starts, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["doc_id", "mark", "start", "run"])

    return run


def _telling(min_match: int, coverage: float) -> Callable:
    """(key, item, df) -> the seeds that a document must hit one of to cover ``coverage`` of the item: all but the most frequent ones
    whose places together are fewer tokens than that. ``df`` tells how many documents have a seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, seeds = [], []
            for key, tokens, known in zip(*(c.to_pylist() for c in batch.columns)):
                line, df = np.array(tokens, np.int64).view(np.uint64), {d["seed"]: d["df"] for d in known or ()}
                size = min(min_match, max(1, line.size))
                found, which = np.unique(window_hashes(line, size), return_inverse=True)
                found = found.view(np.int64)
                places = np.split(np.argsort(which, kind="stable"), np.cumsum(np.bincount(which, minlength=found.size))[:-1])
                free, kept, left = np.ones(line.size, bool), np.ones(found.size, bool), coverage * line.size
                for i in sorted(range(found.size), key=lambda i: (-df.get(int(found[i]), 0), int(found[i]))):
                    for at in places[i].tolist():
                        left -= int(free[at : at + size].sum())
                        free[at : at + size] = False
                    if left <= 0:
                        break
                    kept[i] = False
                keys += [key] * int(kept.sum())
                seeds.append(found[kept])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate(seeds) if seeds else [], pa.int64())], names=["key", "seed"])

    return run


def _tile(min_match: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for item, runs in zip(pdf["item"], pdf["runs"]):
                pattern = np.asarray(item, np.int64).view(np.uint64)
                lines = [np.asarray(r["run"], np.int64).view(np.uint64) for r in sorted(runs, key=lambda r: r["start"])]
                # Runs without a window of the item can't hold a tile of it.
                own = window_hashes(pattern, min_match)
                lines = [x for x in lines if x.size < min_match or pattern.size < min_match or np.isin(window_hashes(x, min_match), own).any()]
                made = tiles(pattern, lines, min_match)
                if pattern.size < min_match and any(np.array_equal(pattern, x) for x in lines):
                    made = [(pattern.size, 0, 0, 0)]
                rows.append((sum(m[0] for m in made) / max(1, pattern.size), len(made), max((m[0] for m in made), default=0)))
            out = pd.DataFrame(rows, columns=["coverage", "n_tiles", "longest_tile"])
            yield pd.concat([pdf[["doc_id", "mark", "key", "item_id"]].reset_index(drop=True), out], axis=1)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE) -> DataFrame:
    """``(doc_id, mark, key, item_id, coverage, n_tiles, longest_tile)`` of documents whose tiles cover ``coverage`` of an item or more.

    ``mark`` is the text's XXH64, so that repeated or null ids don't mix; repeated rows give one result. An item is its id (null is
    one) and its tokens, ``key`` tells items of one id apart; repeated items count once. Null and empty texts have no tiles and
    cover nothing; an item of fewer than ``min_match`` tokens is met only by a text of just these tokens. Ties between tiles go by
    their places. Other columns are left out.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(_items, "item_id long, item array<bigint>, key long")
    items = stash(items.where(F.size("item") > 0).dropDuplicates(["key"]))
    seeds = stash(items.select("key", "item").mapInArrow(_seeds(min_match, ("key", "seed", "n")), "key long, seed long, n long"))
    bits = min(MAX_BITS, max(MIN_BITS, int(512 * seeds.count()).bit_length()))
    words = np.zeros(1 << (bits - 6), np.uint64)
    for row in _bitmap_words(seeds.select("seed"), bits).toLocalIterator():  # one long per word that isn't zero: 2^21 at most
        words[row["word"]] = np.int64(row["value"]).view(np.uint64)
    bitmap = spark.sparkContext.broadcast(words)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("mark"))
    runs = texts.mapInArrow(_runs(bitmap, bits, min_match), "doc_id long, mark long, start long, run array<bigint>")
    runs = stash(runs.withColumn("run_id", F.xxhash64("run")))
    met = _candidates(runs, items, seeds, min_match, coverage)
    every = runs.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "run")).alias("runs"))
    same = F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("r.mark") == F.col("m.mark"))
    pairs = every.alias("r").join(met.alias("m"), same).select("r.doc_id", "r.mark", "key", "runs")
    # Few bytes and much work each: as many tasks as there are partitions, however small.
    pairs = pairs.join(items, "key").repartition(tasks, "doc_id", "mark", "key")
    tiled = pairs.select("doc_id", "mark", "key", "item_id", "item", "runs").mapInPandas(_tile(min_match), "doc_id long, mark long, key long, item_id long, coverage double, n_tiles long, longest_tile long")
    return tiled.where(F.col("coverage") >= coverage)


def _candidates(runs: DataFrame, items: DataFrame, seeds: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """(doc_id, mark, key) of documents that may cover enough of an item. A line that many items and documents share makes no pairs: only
    an item's rarer seeds do, one of which every leak has."""
    # A passage that many documents share is one run, with the number of its documents: its seeds are joined once.
    alike = runs.groupBy("run_id").agg(F.first("run").alias("run"), F.count(F.lit(1)).alias("docs"))
    alike = stash(alike)
    of_runs = stash(alike.select("run_id", "run").mapInArrow(_seeds(min_match, ("run_id", "seed", "times")), "run_id long, seed long, times long").select("run_id", "seed"))
    frequent = of_runs.join(alike.select("run_id", "docs"), "run_id").groupBy("seed").agg(F.sum("docs").alias("df"))
    known = seeds.join(frequent, "seed").groupBy("key").agg(F.collect_list(F.struct("seed", "df")).alias("df"))
    telling = items.select("key", "item").join(known, "key").mapInArrow(_telling(min_match, coverage), "key long, seed long")
    wanted = of_runs.join(telling, "seed").groupBy("run_id").agg(F.collect_set("key").alias("keys"))
    return spread_join(runs, stash(wanted), "run_id", "mark").select("doc_id", "mark", F.explode("keys").alias("key")).distinct()


def _bitmap_words(seeds: DataFrame, bits: int) -> DataFrame:
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_probes(batch.column(0).to_numpy().view(np.uint64), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    return seeds.mapInArrow(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("value"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, coverage, n_tiles, longest_tile)`` of contaminated documents, see ``leaks``."""
    return leaks(docs, benchmark).drop("mark", "key")


#: Contaminated documents of which every task may hold the marks (16 MB); of more, the documents are shuffled to them.
FEW = 1_000_000


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without contaminated ones, in all their columns. Repeated rows go or stay together, null ids by their text."""
    bad = at_most(stash(leaks(docs, benchmark).select(F.col("doc_id").alias("_doc"), F.col("mark").alias("_mark")).distinct()), FEW)
    same = docs["doc_id"].cast("long").eqNullSafe(bad["_doc"]) & (F.xxhash64(docs["text"].cast("string")) == bad["_mark"])
    return docs.join(bad, same, "left_anti")
